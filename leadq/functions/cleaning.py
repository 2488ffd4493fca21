"""Value cleaning. Each rule takes raw text and gives a normal form or NULL; none of them fails.

Rules that look at an intermediate value more than once come in two steps, so that the
operator (`operators.clean`) can put the intermediate value in a column of its own and the
work is done once per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadq import schema as S
from leadq.functions.strings import SPACE_RUN, any_of, blank_to_null, lookup, strip

# --- names -------------------------------------------------------------------------------


def name_words(full_name: Column) -> Column:
    """Words of a name; NULL for a blank one."""
    return F.split(blank_to_null(full_name), SPACE_RUN)


def first_word(words: Column) -> Column:
    return F.try_element_at(words, F.lit(1))


def rest_of_words(words: Column) -> Column:
    return F.when(F.size(words) > 1, F.array_join(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), " "))


def usable_name(name: Column, max_length: int = 100) -> Column:
    """The name if more than half of its non-space characters are letters of any script,
    cut to `max_length`; otherwise NULL."""
    letters = F.length(F.regexp_replace(name, r"[^\p{L}]", ""))
    visible = F.length(F.regexp_replace(name, SPACE_RUN, ""))
    plain = name.rlike("^[A-Za-z]+$")  # most names; saves the two replacements
    return F.when(plain | (letters * 2 > visible), F.substring(name, 1, max_length))


# --- phone -------------------------------------------------------------------------------

_KEYPAD = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "22233344455566677778889999")
_EXTENSION = r"(?i)[\s,;]*(?:;?ext(?:n|ension)?[.:=]?|x|#)\s*[0-9]{1,7}#?$"
_VIABLE = r"^[+]?(?:[-\s./()\[\]~*]*[0-9]){3}[-\s./()\[\]~*A-Za-z0-9]*$"


_PLAIN_PHONE = r"^[(]?[+]?[-0-9 ().]*$"


def phone_digits(text: Column) -> Column:
    """Digits of a stripped phone text with an optional leading '+'; NULL when it is no number.

    Text before the first digit or '+' and a trailing extension are dropped; three letters or
    more after the first digits are read as keypad letters. Plain punctuated digits, which is
    most numbers, need none of this.
    """
    start = F.regexp_extract(text, r"[+0-9].*", 0)
    core = F.regexp_replace(start, _EXTENSION, "")
    spelled = F.when(core.rlike(r"(?:.*[A-Za-z]){3}"), F.translate(F.upper(core), *_KEYPAD)).otherwise(core)
    digits = F.regexp_replace(spelled, r"[^0-9]", "")
    read = F.when(core.rlike(_VIABLE), F.when(core.startswith("+"), F.concat(F.lit("+"), digits)).otherwise(digits))
    return F.when(text.rlike(_PLAIN_PHONE), F.translate(text, "-() .", "")).otherwise(read)


def foreign_digits(d: Column) -> Column:
    """Country code and number of a number dialled with '+' or the US prefix for abroad."""
    return F.when(d.startswith("+"), F.substring(d, F.lit(2), F.length(d))).when(
        d.startswith("011") & (F.length(d) > 10), F.substring(d, F.lit(4), F.length(d))
    )


def us_digits(d: Column, foreign: Column) -> Column:
    return (
        F.when(foreign.startswith("1"), F.substring(foreign, F.lit(2), F.length(foreign)))
        .when(foreign.isNotNull(), F.lit(None))
        .when((F.length(d) == 11) & d.startswith("1"), F.substring(d, 2, 10))
        .otherwise(d)
    )


def e164(us: Column, foreign: Column) -> Column:
    """E.164 form, with the US as default country; lengths are checked, ranges are not.

    US numbers have 10 digits, or 7 for a local one. Other countries are accepted with 7 to 15
    digits. A number made of zeros only is no number: it would join strangers.
    """
    return F.when(
        F.length(us).isin(7, 10) & (F.translate(us, "0", "") != ""), F.concat(F.lit("+1"), us)
    ).when(foreign.rlike("^[2-9][0-9]{6,14}$"), F.concat(F.lit("+"), foreign))


def normalize_phone(phone: Column) -> Column:
    d = phone_digits(strip(phone))
    return e164(us_digits(d, foreign_digits(d)), foreign_digits(d))


# --- email -------------------------------------------------------------------------------

# Possessive quantifiers: the parts exclude each other's first character, so nothing is tried twice.
_ATOM = r"[\p{L}\p{M}\p{N}!#$%&'*+/=?^_`{|}~-]++"
_LABEL = r"(?![-\p{M}])[\p{L}\p{M}\p{N}-]{1,63}+(?<!-)"
_EMAIL = rf"^{_ATOM}(?:\.{_ATOM})*+@(?:{_LABEL}\.)++(?!-)[\p{{L}}\p{{N}}-]++(?<=\p{{L}})$"
_RESERVED_TOP_DOMAINS = ["arpa", "invalid", "local", "localhost", "onion", "test"]


def email_text(email: Column) -> Column:
    return F.lower(strip(email))


def valid_email(text: Column) -> Column:
    """The lower-cased text if it has the form of an address that could be delivered to."""
    at = F.instr(text, "@")
    in_length = (F.length(text) <= 254) & (at > 1) & (at <= 65)
    reserved = F.substring_index(text, ".", -1).isin(_RESERVED_TOP_DOMAINS)
    return F.when(in_length & text.rlike(_EMAIL) & ~reserved, text)


def email_domain(email: Column) -> Column:
    return F.substring_index(email, "@", -1)


def fix_email_domain(email: Column) -> Column:
    """Repair a mistyped provider domain of a valid, lower-cased address."""
    fixed = lookup(S.EMAIL_DOMAIN_TYPOS, email_domain(email))
    return F.coalesce(F.concat(F.substring_index(email, "@", 1), F.lit("@"), fixed), email)


def normalize_email(email: Column) -> Column:
    return fix_email_domain(valid_email(email_text(email)))


# --- consent -----------------------------------------------------------------------------


def consent_from_text(text: Column) -> Column:
    """Never NULL: whatever is not clearly a yes is a no. Negative phrases go first because
    several of them contain a positive one."""
    return (
        F.when(text.isin(S.CONSENT_YES), True)
        .when(text.isin(S.CONSENT_NO), False)
        .when(text.rlike(any_of(S.CONSENT_NO_PHRASES)), False)
        .when(text.rlike(any_of(S.CONSENT_YES_PHRASES)), True)
        .otherwise(False)
    )


def normalize_consent(value: Column) -> Column:
    return consent_from_text(F.lower(strip(value)))


# --- timestamps --------------------------------------------------------------------------

_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
_MONTH = (
    r"((?i:jan(?=uary|[^a-z])|feb(?=ruary|[^a-z])|mar(?=ch|[^a-z])|apr(?=il|[^a-z])|may|jun(?=e|[^a-z])|"
    r"jul(?=y|[^a-z])|aug(?=ust|[^a-z])|sep(?=t|[^a-z])|oct(?=ober|[^a-z])|nov(?=ember|[^a-z])|dec(?=ember|[^a-z])))"
    r"[A-Za-z]*\.?"
)
# Date shapes and the year-month-day order they are brought into.
_NUMBER_DATES = [
    (r"^(1[3-9]|[23][0-9])[-/.]([0-9]{1,2})[-/.]([0-9]{4})(?![0-9])", "$3-$2-$1"),  # day first: no such month
    (r"^([0-9]{1,2})[-/.]([0-9]{1,2})[-/.]([0-9]{4})(?![0-9])", "$3-$1-$2"),
]
_NAMED_DATES = [
    (r"^([0-9]{1,2})[-/. ]" + _MONTH + r"[-/., ]+([0-9]{4})(?![0-9])", "$3-$2-$1"),
    (r"^" + _MONTH + r"[- ]+([0-9]{1,2})[, -]+([0-9]{4})(?![0-9])", "$3-$1-$2"),
]
_YEAR_DATES = [
    (r"^([0-9]{4})/([0-9]{1,2})/([0-9]{1,2})(?![0-9])", "$1-$2-$3"),
    (r"^([0-9]{4})([0-9]{2})([0-9]{2})(?![0-9])", "$1-$2-$3"),
    (r"^([0-9]{4})([0-9]{2})([0-9]{2})([0-9]{2})([0-9]{2})([0-9]{2})$", "$1-$2-$3 $4:$5:$6"),
]
_FULL_ISO = r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}(?:[T ][0-9]{1,2}:[0-9]{2}:[0-9]{2}Z?)?$"
_ISO = (
    r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}"
    r"(?:[T ,]+[0-9]{1,2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]{1,9})?)?(?:\s*[AaPp][Mm])?"
    r"(?:\s*(?:[Zz]|UTC|GMT|[+-][0-9]{2}:?[0-9]{2}))?)?$"
)


def _reordered(text: Column, shapes: list[tuple[str, str]]) -> Column:
    for shape, order in shapes:
        text = F.regexp_replace(text, shape, order)
    return text


def year_first(text: Column) -> Column:
    """Bring the date at the start of a text into year-month-day order."""
    return (
        F.when(text.rlike("^[0-9]{4}-"), text)
        .when(text.rlike("^[0-9]{1,2}[-/.][0-9]"), _reordered(text, _NUMBER_DATES))
        .when(text.rlike("^[0-9]{4}"), _reordered(text, _YEAR_DATES))
        .otherwise(_reordered(text, _NAMED_DATES))
    )


def month_as_number(date: Column) -> Column:
    name = F.lower(F.regexp_extract(date, r"^[0-9]{4}-([A-Za-z]{3})-", 1))
    number = F.floor((F.instr(F.lit(_MONTHS), name) + 2) / 3).cast("string")
    return F.when(name != "", F.concat(F.substring(date, 1, 5), number, F.substring(date, F.lit(9), F.length(date)))).otherwise(date)


def timestamp_from_iso(iso: Column, text: Column, epoch_text: bool = True) -> Column:
    """UTC timestamp of a year-first text; without a zone it is UTC. `epoch_text` takes a `text`
    of 9 to 11 digits as epoch seconds (shorter and longer ones are dates without separators). What names no full day is NULL."""
    plain = F.regexp_replace(iso, r"\s*[AaPp][Mm]", "")
    plain = F.regexp_replace(plain, r"^([0-9-]+)[T ,]+([0-9]{1,2}:[0-9]{2})(?!:?[0-9])", "$1 $2:00")
    plain = F.regexp_replace(plain, r"\s*([+-][0-9]{2}):?([0-9]{2})$", "$1:$2")
    half = F.lower(F.regexp_extract(iso, r"([0-9]{1,2}):[0-9:.]+\s*([AaPp])[Mm]", 2))
    hour = F.regexp_extract(iso, r"([0-9]{1,2}):", 1)
    shift = F.when((half == "p") & (hour != "12"), 12).when((half == "a") & (hour == "12"), -12).otherwise(0)
    moment = F.when(iso.rlike(_FULL_ISO), iso.try_cast("timestamp")).when(
        iso.rlike(_ISO), plain.try_cast("timestamp") + F.make_interval(hours=shift)
    )
    if epoch_text:
        seconds = F.when(text.rlike(r"^[0-9]{9,11}(?:\.[0-9]+)?$"), F.timestamp_seconds(text.try_cast("double")))
        return F.coalesce(moment, seconds)
    return moment


def parse_timestamp(value: Column, epoch_text: bool = True) -> Column:
    text = strip(value)
    return timestamp_from_iso(month_as_number(year_first(text)), text, epoch_text)
