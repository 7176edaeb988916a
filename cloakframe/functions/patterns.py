"""The recognizer catalogue: what a pattern finds, how sure it is, and what confirms it.

The e-mail pattern and its score are fixed by the semantics; the other pattern recognizers and the
rule-based name recognizers are this library's own choice.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column

from cloakframe.functions import validators as V


@dataclass(frozen=True)
class Recognizer:
    """entity_type, a Java pattern and a score; validate keeps a match; context words near it add boost.

    hint: what every match holds, literally or (hint_is_pattern) by a cheaper pattern.
    """

    name: str
    entity_type: str
    pattern: str
    score: float
    validate: Callable[[Column], Column] | None = None
    context: tuple[str, ...] = ()
    boost: float = 0.35
    hint: str | None = None
    hint_is_pattern: bool = False


# The e-mail pattern and score.
EMAIL = Recognizer("AnyDomainEmail", "EMAIL_ADDRESS", r"(?U)(?<![\w.%+-])[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,63}(?![\w-])", 0.9, hint="@")

IPV4 = Recognizer("IpV4", "IP_ADDRESS", r"(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\w.]*\w)", 0.6, V.ipv4)
PHONE = Recognizer("Phone", "PHONE_NUMBER", r"(?<![\w+])\+?[0-9]{1,3} ?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?!\w)", 0.5, None, ("phone", "call", "tel"))
CARD = Recognizer("Card", "CREDIT_CARD", r"(?<!\w)[0-9](?:[ -]?[0-9]){12,18}(?!\w)", 0.7, V.luhn, ("card", "visa", "credit"))
URL = Recognizer("Url", "URL", r"(?<!\w)https?://[^\s<>\"']+[^\s<>\"'.,;:!?)]", 0.6, hint="://")
SSN = Recognizer("Ssn", "US_SSN", r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])", 0.6, V.ssn, ("ssn", "social security"))
IBAN = Recognizer("Iban", "IBAN_CODE", r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)", 0.8, V.iban)
DATE = Recognizer(
    "Date",
    "DATE_TIME",
    r"(?<!\w)(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[/.][0-9]{1,2}[/.][0-9]{4}|(?i:January|February|March|April|May|June|July|August|September|October|November|December) [0-9]{1,2},? [0-9]{4}|[0-9]{1,2} (?i:January|February|March|April|May|June|July|August|September|October|November|December),? [0-9]{4})(?!\w)",
    0.6,
)
HEX_TOKEN = Recognizer("HexToken", "ID_NUMBER", r"(?<!\w)[0-9a-f]{40}(?!\w)", 0.5, None, ("token", "key", "secret"))
PATTERNS = [EMAIL, IPV4, PHONE, CARD, URL, SSN, IBAN, DATE, HEX_TOKEN]

_NAME = r"\p{Lu}[\p{L}'’-]+"
TITLED_PERSON = Recognizer("TitledName", "PERSON", rf"(?<!\w)(?<=(?:Mr|Mrs|Ms|Dr|Prof|Sir|Mme|Herr|Frau)\.? ){_NAME}(?: {_NAME}){{0,2}}", 0.6)
FULL_NAME = Recognizer("LabelledName", "PERSON", rf"(?<=(?:[Nn]ame|[Ff]rom|[Dd]ear|[Cc]ontact|[Ss]igned by): ?){_NAME} {_NAME}", 0.55, hint=r"(?:[Nn]ame|[Ff]rom|[Dd]ear|[Cc]ontact|[Ss]igned by): ?\p{Lu}", hint_is_pattern=True)
COMPANY = Recognizer("CompanySuffix", "ORGANIZATION", rf"(?<!\w){_NAME}(?: (?:{_NAME}|&|of|and)){{0,3}} (?:Ltd|Limited|LLC|LLP|Inc|Corp|Corporation|GmbH|AG|SA|BV|PLC|plc)\b", 0.6)
#: A rule-based stand-in for a span model, so that names can seed propagation without model files.
NAME_RULES = [TITLED_PERSON, FULL_NAME, COMPANY]

ALL = PATTERNS + NAME_RULES
