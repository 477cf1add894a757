"""Explicit schemas of the tables that go in and out, as DDL that every reader and createDataFrame accepts."""
from __future__ import annotations

DOCUMENTS = (
    "doc_id long, platform string, container string, path string, source_url string, content_type string, "
    "branch string, text string, is_ocr_derived boolean, metadata map<string,string>"
)
REPOS = (
    "owner string, full_name string, name string, html_url string, default_branch string, size_kb long, "
    "private boolean, updated_at timestamp"
)
FILES = ("repo string, branch string, path string, type string, size long")
PASTES = (
    "paste_id string, url string, raw_url string, title string, syntax string, size int, expire string, source string"
)
PASTE_INDEX_PAGES = ("page_id long, url string, html string")
FORUM_JSON = ("username string, kind string, body string")
CHANNEL_MESSAGES = ("channel string, message_id long, content string, date timestamp, url string")
OCR_TEXTS = ("source_url string, repo_id string, file_path string, text string")
SENTENCES = ("doc_id long, s int, e int, text string")
ENTITIES = ("doc_id long, label string, s int, e int")
SENTENCE_SCORES = ("sentence string, scores map<string,double>")
FINDINGS = (
    "doc_id long, type string, value string, value_masked string, snippet string, confidence decimal(6,3), "
    "risk string, annotation string, start int, end int, file_path string, source string, source_url string, "
    "platform string, content_type string"
)
ESS = (
    "source_key string, score double, base_score double, toxic_combo_label string, toxic_multiplier double, "
    "exposure_multiplier double, confidence_penalty double, types_found array<string>, "
    "breakdown struct<base_score:double,after_toxic_combo:double,after_exposure:double,confidence_penalty:double,"
    "final_score:double>"
)
HISTORY = (
    "id long, user_email string, scan_type string, target string, findings_count int, max_ess double, "
    "ess_label string, sources_scanned int, scan_duration double, created_at timestamp"
)
PROFILES = (
    "user_email string, entries array<struct<kind:string,label:string,value:string>>, notes string, "
    "updated_at timestamp"
)
ALERT_EVENTS = (
    "type string, value string, risk string, source string, source_url string, detected_at timestamp"
)
SCAN_SESSIONS = (
    "session_id long, started_at timestamp, completed_at timestamp, scan_type string, target string, "
    "total_files long, total_findings long, max_ess double, avg_ess double"
)
PLATFORMS = (
    "session_id long, platform string, identifier string, url string, branch string, scanned_at timestamp, "
    "file_count long, finding_count long, ess_score double, is_public boolean"
)
LEAK_RECORDS = (
    "session_id long, platform string, file_path string, source_url string, line_start int, char_start int, "
    "char_end int, entity_type string, value_masked string, snippet string, confidence double, risk string, "
    "annotation string, ess_contribution double, detected_at timestamp, identity_cluster_id string"
)
ESS_RECORDS = (
    "session_id long, platform string, source_identifier string, ess_score double, ess_label string, "
    "base_score double, toxic_combo string, toxic_multiplier double, exposure_multiplier double, "
    "types_found array<string>, breakdown struct<base_score:double,after_toxic_combo:double,after_exposure:double,"
    "confidence_penalty:double,final_score:double>, calculated_at timestamp"
)
ALERT_BATCH = (
    "window_start timestamp, window_end timestamp, total long, critical long, high long, medium long, "
    "sample_size int, findings array<struct<type:string,value_masked:string,risk:string,source:string>>"
)
