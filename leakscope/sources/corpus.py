"""A corpus with known leaks derived from the customer table, for tests and benchmarks. Integer arithmetic only."""
from __future__ import annotations

from pyspark.sql import DataFrame

from leakscope.sources.layout import spread

CORPUS_SQL = """
with base as (select c_custkey as k,
 concat(cast(2 + c_custkey % 8 as varchar(20)), lpad(cast((c_custkey * 7919 + 104729) % 100000000000 as varchar(20)), 11, '0')) as aadhaar,
 concat(chr(cast(65 + c_custkey % 26 as int)), chr(cast(65 + (c_custkey * 5) % 26 as int)), chr(cast(65 + (c_custkey * 7) % 26 as int)),
        substring('CPHABGJLFTEXYZ', cast(1 + c_custkey % 14 as int), 1), chr(cast(65 + (c_custkey * 3) % 26 as int)),
        lpad(cast(c_custkey % 10000 as varchar(20)), 4, '0'), chr(cast(65 + (c_custkey * 11) % 26 as int))) as pan,
 cast(6000000000 + (c_custkey * 7919) % 4000000000 as varchar(20)) as phone,
 concat('user', cast(c_custkey as varchar(20)), '@mail', cast(c_custkey % 5 as varchar(20)), '.example.com') as email,
 concat(lpad(cast(c_custkey % 1000 as varchar(20)), 3, '0'), '-', lpad(cast(c_custkey % 100 as varchar(20)), 2, '0'), '-', lpad(cast(c_custkey % 10000 as varchar(20)), 4, '0')) as ssn,
 concat('4', lpad(cast((c_custkey * 48271) % 1000000000000000 as varchar(20)), 15, '0')) as card,
 c_nationkey, c_custkey % 4 as src
from customer)
select k, concat('repo', cast(c_nationkey as varchar(20))) as container, concat('src/f', cast(k % 50 as varchar(20)), '.py') as path,
 case src when 0 then 'github_public' when 1 then 'pastebin' when 2 then 'social_reddit' else 'telegram' end as platform,
 case k % 10
  when 0 then concat('my aadhaar ', aadhaar, ' and pan ', pan, ' phone number +91 ', phone, ' .')
  when 1 then concat('call +91', phone, ' now')
  when 2 then concat('pay with ', card, ' today ', email, ' thanks')
  when 3 then concat('ssn ', ssn, ' was leaked')
  when 4 then concat('ssn ', ssn, ' sample')
  when 5 then concat('aadhaar card ', aadhaar, ' kept')
  when 6 then concat('id ', substring(aadhaar,1,4), ' ', substring(aadhaar,5,4), '-', substring(aadhaar,9,4), ' seen')
  when 7 then concat('write to ', email, ' or ', phone, ' ok')
  when 8 then concat('pan ', pan, ' card ', card, ' end')
  else concat('order ', cast(k as varchar(20)), ' shipped') end as text
from base
"""


def leak_corpus(customer: DataFrame) -> DataFrame:
    """(k, container, path, platform, text) from the customer table, whose two columns are spread before texts are made and scanned."""
    keys = spread(customer.select("c_custkey", "c_nationkey"))
    return customer.sparkSession.sql(CORPUS_SQL.replace("from customer)", "from {customer})"), customer=keys)


def corpus_documents(customer: DataFrame) -> DataFrame:
    """The corpus with the columns of the document table."""
    return leak_corpus(customer).selectExpr(
        "k as doc_id", "platform", "container", "path",
        "concat('https://example.org/', container, '/', path, '#', k) as source_url", "'file' as content_type",
        "'main' as branch", "text",
    )
