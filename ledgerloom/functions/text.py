"""Column expressions for cells of statements: amounts, dates, narrations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

DATE_FORMATS = ("yyyy-MM-dd", "dd/MM/yyyy", "dd-MM-yyyy", "dd MMM yyyy", "dd-MMM-yy")
#: Rows of a statement that are no transactions.
JUNK = r"(?i)(page \d+ of \d+|statement of account|this is a computer generated|\*{3,}|end of statement|generated on|opening balance|closing balance|brought forward)"
NOISE_EXACT, NOISE_PREFIX = ("TOTAL", "GRAND TOTAL"), ("OPENING BALANCE", "CLOSING BALANCE", "BROUGHT FORWARD", "CARRIED FORWARD")


def clean_numeric(value: Column, dr_is_negative: bool = False) -> Column:
    """Amount text as decimal(18,2): grouping commas, currency marks, (x), a sign, a trailing Dr or Cr; what
    can't be read is 0."""
    v = F.trim(F.coalesce(value, F.lit("")))
    bracket = v.rlike(r"^\(.*\)$")
    v = F.when(bracket, F.trim(F.regexp_replace(v, r"^\((.*)\)$", "$1"))).otherwise(v)
    mark = F.upper(F.regexp_extract(v, r"(?i)(dr|cr)\.?$", 1))
    v = F.trim(F.regexp_replace(v, r"(?i)\s*(dr|cr)\.?$", ""))
    v = F.regexp_replace(F.regexp_replace(v, r"(?i)(₹|\brs\.?|\binr\b|\$)", ""), r"[,\s]", "")
    minus = v.startswith("-")
    v = F.regexp_replace(v, r"^[-+]", "")
    number = F.coalesce(v.try_cast("decimal(18,2)"), F.lit(0).cast("decimal(18,2)"))
    flips = bracket.cast("int") + minus.cast("int")
    # A bracket and a minus undo each other; a Dr of an overdrawn balance counts with the bracket.
    if dr_is_negative:
        flips = F.when(bracket | (mark == "DR"), 1).otherwise(0) + minus.cast("int")
    return F.when(flips % 2 == 1, -number).otherwise(number).cast("decimal(18,2)")


def parse_date(value: Column) -> Column:
    """The first of the known formats that fits; day first."""
    return F.coalesce(*[F.try_to_timestamp(F.trim(value), F.lit(f)) for f in DATE_FORMATS]).cast("date")


def is_junk(description: Column) -> Column:
    return F.coalesce(description, F.lit("")).rlike(JUNK)


def is_noise(description: Column) -> Column:
    u = F.upper(F.trim(description))
    out = u.isin(*NOISE_EXACT)
    for p in NOISE_PREFIX:
        out = out | u.startswith(p)
    return out


def clean_description(c: Column) -> Column:
    """White space and spaced hyphens put right."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"[\r\n\t]+", " "), r"\s*-\s*", "-"), r" {2,}", " "))


def holds(text: Column, words: str) -> Column:
    """The text holds one of the plain words of `A|B|C`: as `rlike` without a regular expression."""
    return reduce(Column.__or__, [F.contains(text, F.lit(w)) for w in words.split("|")])


def rail(description: Column) -> Column:
    """The payment rail: the first of an ordered list of marks that a narration holds."""
    u = F.upper(description)
    has = lambda *marks: F.greatest(F.lit(False), *[F.contains(u, F.lit(m)) for m in marks])
    return F.when(has("UPI"), "UPI").when(has("ACH"), "ACH/NACH").when(has("NEFT"), "NEFT").when(has("IMPS"), "IMPS").when(has("RTGS"), "RTGS").when(has("CAM/", "CASH WDL", "CWDR", "ATW"), "ATM_CASH").when(has("CLG/", "CHEQUE"), "CHEQUE").when(has("EBA/"), "DIRECT_BROKER").otherwise("OTHER")


def payee(description: Column) -> Column:
    """The other party by the narration's form, the first that fits; else its first 30 characters."""
    s = F.trim(description)
    slash, dash = (lambda i: F.get(F.split(s, "/"), F.lit(i))), (lambda i: F.get(F.split(s, "-"), F.lit(i)))
    transfer = F.regexp_extract(s, r"(?i)(?:TO|BY)\s+TRANSFER-UPI/(?:DR|CR)/[^/]+/([^/]+)", 1)
    merchant = F.regexp_extract(s, r"(?i)UPI/(?:P2M|P2A)/[^/]+/([^/]+)", 1)
    first = slash(1)
    named = ~F.replace(first, F.lit("."), F.lit("")).rlike(r"^\d+$") & (F.length(first) > 2)
    return (
        F.when(transfer != "", F.upper(transfer))
        .when(merchant != "", F.upper(merchant))
        .when(s.startswith("UPI/") & named, F.upper(first))
        .when(s.startswith("UPI/") & slash(2).isNotNull(), F.upper(slash(2)))
        .when(s.startswith("UPI-"), F.upper(dash(1)))
        .when(s.startswith("ACH/"), F.upper(first))
        .when((F.contains(s, F.lit("NEFT/")) | F.contains(s, F.lit("IMPS/"))) & slash(3).isNotNull(), F.upper(slash(3)))
        .when(s.startswith("EBA/"), F.concat(F.lit("EBA_"), F.replace(dash(0), F.lit("EBA/"), F.lit(""))))
        .otherwise(F.upper(F.trim(F.substring(F.regexp_replace(s, "[/_:-]", " "), 1, 30))))
    )


def mask_personal(text: Column) -> Column:
    """Card numbers of 16 digits keep their last four, mobile numbers of ten their ends."""
    card = F.regexp_replace(text, r"(?<![0-9])[0-9]{12}([0-9]{4})(?![0-9])", "XXXXXXXXXXXX$1")
    return F.regexp_replace(card, r"(?<![0-9])([6-9][0-9])[0-9]{6}([0-9]{2})(?![0-9])", "$1XXXXXX$2")


def token_matches(text: Column, token: str) -> Column:
    """Short tokens need word boundaries, longer ones may stand inside words."""
    t = F.lower(text)
    return t.rlike(rf"(^|[^a-z0-9]){token}([^a-z0-9]|$)") if len(token) <= 4 else F.contains(t, F.lit(token))


def ratio(a: Column, b: Column) -> Column:
    """a / b as double; null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))
