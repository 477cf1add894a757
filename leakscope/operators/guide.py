"""What to know and do about exposed identifiers: one table, from which reports and playbooks take their sentences."""
from __future__ import annotations

from typing import NamedTuple


class Guide(NamedTuple):
    """harm: what a stranger can do with the value; first: the step that stops it; tell: who has to know; hours: until when."""

    harm: str
    first: str
    tell: str
    hours: int
    types: tuple[str, ...] = ()  # other names of the type
    noted: bool = True  # whether playbooks speak of it

    @property
    def step(self) -> str:
        return f"{self.first} {self.tell} should know within {self.hours} h."


GUIDES: dict[str, Guide] = {
    "IN_AADHAAR": Guide("Whoever reads it can pose as this resident where the number is taken on trust.", "Switch off biometric sign-in for the number.", "The authority that issued it", 24),
    "IN_PAN": Guide("Loans and declarations can be filed under a name that isn't the filer's.", "Order a credit record and mark every line the owner doesn't know.", "The tax office", 72),
    "IN_CARD": Guide("Shops that ask for digits only will sell to the reader.", "Freeze the card in the banking app.", "The bank behind the card", 1),
    "IN_GSTIN": Guide("Sales that never took place can be booked to this firm.", "Compare the firm's ledger with what the portal shows.", "The firm's accountant", 72, noted=False),
    "IN_UPI": Guide("Requests for money can be sent that look like those of an acquaintance.", "Decline what is pending and choose another handle.", "The app that holds the handle", 24),
    "IN_ABHA": Guide("Records of treatment can be asked for under this number.", "List the consents that are in force and end the unknown ones.", "The clinic that opened the record", 48),
    "IN_PASSPORT": Guide("Bookings and border forms can carry this person's number.", "Have the booklet flagged as compromised.", "The consulate or passport office", 48),
    "PHONE_NUMBER_INDIA": Guide("Codes sent by text message may reach another handset.", "Move sign-in codes from text messages to an authenticator.", "The network operator", 24, ("PHONE_NUMBER",)),
    "EMAIL_ADDRESS": Guide("Accounts that are recovered through this mailbox become guessable.", "End all open sessions and set a new passphrase.", "Whoever runs the mailbox", 24, noted=False),
}
#: Where no type of a scan has a step.
NOTHING_TO_DO = "Nothing found here calls for a step by its owner."
#: Where no type of a playbook is spoken of.
EVERYONE = "Write down what was exposed, since when and to whom; tell the people concerned if the law where they live asks for it."
NO_FINDINGS = "This scan came back empty."
