"""Narrations of bank statements read into fields: a table of forms for each bank, and a reader for any bank.

A form is a test and the places of its fields. The first form of a bank whose test a narration meets is read; what it
leaves blank is filled by the general reader, which goes by the look of a field and not by its place. All of it is
native expressions: rows stay where they are. `parsed` reads in steps, each a projection of its own: what a step makes is
made once a row, and its tests become small compiled methods; `parse` is the same as one expression."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("rail", "ref", "payee", "vpa", "remarks", "bank")
FLAGS = ("is_p2m", "is_p2a")
#: Fixed: what a field with the name of a bank or payment service holds, cut short as banks do, and whole words that it holds.
BANK_PARTS = (
    "bank|paytm|ybl|okaxis|okhdfc|okicici|oksbi|okbizaxis|apl|ibl|axl|airtel|jio|fino|equitas|au small|idfc|indusind|federal|kotak|canara|union|baroda|maharashtra|saraswat|cosmos|abhyudaya|district cent|"
    "punjab|indian ban|central ban|uco|iob|karnataka|karur|tamilnad|dbs|citi|hsbc|standard char|rbl|bandhan|ujjivan|jana |suryoday"
)
BANK_WORDS = "sbi|hdfc|icici|axis|yes|pnb|boi|bob"


def any_of(words: str) -> str:
    """A pattern for one of the plain words of `A|B|C`, those with common beginnings together, so that few alternatives are
    tried at a place. Of words that begin one another the shortest is found."""
    heads: dict[str, list[str]] = {}
    for w in words.split("|"):
        heads.setdefault(w[0], []).append(w[1:])
    found = [re.escape(c) + ("" if "" in tails else any_of("|".join(tails))) for c, tails in heads.items()]
    return found[0] if len(found) == 1 else f"(?:{'|'.join(found)})"


BANK_FIELD = rf"(?i){any_of(BANK_PARTS)}|\b{any_of(BANK_WORDS)}\b"
#: Fixed: words that name a rail, in the order in which they are looked for.
RAIL_WORDS = (
    ("UPIAB", "UPI"), ("UPI", "UPI"), ("NEFT", "NEFT"), ("RTGS", "RTGS"), ("IMPS", "IMPS"), ("NACH", "NACH"), ("ACH", "ACH"), ("ECS", "ECS"), ("APB", "ACH"), ("CWDR", "ATM"), ("CASH WDL", "ATM"), ("ATW", "ATM"), ("ATM", "ATM"),
    ("CLG", "CHEQUE"), ("CHQ", "CHEQUE"), ("CHEQUE", "CHEQUE"), ("EBA", "EBA"), ("MFP", "EBA"), ("INT.PD", "INTEREST"), ("INT CREDIT", "INTEREST"), ("INTEREST", "INTEREST"), ("SMS CHARGE", "CHARGES"), ("CHARGES", "CHARGES"),
    ("REV-", "REVERSAL"), ("REV/", "REVERSAL"), ("REVERSAL", "REVERSAL"), ("SWEEP TRF", "SAVINGS_SWEEP"), ("MOD TRF", "SAVINGS_SWEEP"), ("SWEEP", "SAVINGS_SWEEP"), ("CEMTEX", "TAX_REFUND"), ("INF/", "INTERNAL_TRANSFER"),
    ("INF", "INTERNAL_TRANSFER"), ("TPC/", "INTERNAL_TRANSFER"), ("TPC", "INTERNAL_TRANSFER"), ("BIL/ONL", "BILL_PAYMENT"), ("BIL/", "BILL_PAYMENT"), ("POS ", "POS_CARD"), ("IPS ", "POS_CARD"), ("BY CASH", "CASH"), ("TO CASH", "CASH"),
)
#: Fixed: fields that are no payee.
NO_PAYEE = "(?i)^(UPI|UPIAB|NEFT|RTGS|IMPS|NACH|ACH|ECS|CLG|CHQ|CHEQUE|ATM|ATW|CWDR|EBA|MFP|APB|DR|CR|P2P|P2M|P2A|WDL|DEP|TFR|TO|BY|REF|BIL|ONL|MMT|CMS|CAM|NFS|INT|SMS|TRF|TRANSFER)$"
VPA, NUMBER = r"\b[A-Za-z0-9._-]{2,}@[A-Za-z]{2,}\b", r"^\d{10,16}$"


@dataclass(frozen=True)
class Text:
    """A narration with its capitals and its fields by separator, each an expression or a column made before."""

    d: Column
    upper: Column
    fields: Callable[[str], Column]

    @classmethod
    def of(cls, d: Column) -> Text:
        return cls(d, F.upper(d), lambda sep: F.split(d, sep))


Reader = Callable[[Text], Column]


def slot(i: int, sep: str = "/", least: int = 0) -> Reader:
    """The i-th field, where there are `least` fields or more."""

    def read(t: Text) -> Column:
        parts = t.fields(sep)
        own = F.trim(F.coalesce(F.get(parts, F.lit(i)), F.lit("")))
        return F.when(F.size(parts) >= least, own).otherwise("") if least else own

    return read


def part(pattern: str, group: int = 1) -> Reader:
    return lambda t: F.trim(F.regexp_extract(t.d, pattern, group))


def rest(n: int) -> Reader:
    """What follows the first n characters."""
    return lambda t: F.trim(F.substring(t.d, F.lit(n + 1), F.length(t.d)))


def whole(t: Text) -> Column:
    return t.d


def stripped(t: Text) -> Column:
    return F.trim(t.d)


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value evaluated once however often `then` uses it: fields of a CASE are otherwise read by
    evaluating the whole of it for each."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def looks_like_bank(c: Column) -> Column:
    return c.rlike(BANK_FIELD)


@dataclass(frozen=True)
class Form:
    """begins, holds: any of which the narration (upper case) begins with or holds; pattern: or which it matches."""

    rail: str
    begins: tuple[str, ...] = ()
    holds: tuple[str, ...] = ()
    pattern: str = ""
    shortest: int = 0
    fields: dict[str, Reader | str] = field(default_factory=dict)
    flags: tuple[str, ...] = ()

    def test(self, t: Text) -> Column:
        if self.shortest:
            return F.length(F.trim(t.d)).between(1, self.shortest)
        tests = [t.upper.startswith(b) for b in self.begins] + [F.contains(t.upper, F.lit(h)) for h in self.holds] + ([t.d.rlike(self.pattern)] if self.pattern else [])
        return tests[0] if len(tests) == 1 else F.greatest(*tests)

    def read(self, t: Text) -> Column:
        own = {"rail": F.lit(self.rail)} | {k: r(t) if callable(r) else F.lit(r) for k, r in self.fields.items()}
        return F.struct(*[own.get(f, F.lit("")).alias(f) for f in FIELDS], *[F.lit(f in self.flags).alias(f) for f in FLAGS])


def _axis_slot(which: str) -> Reader:
    """The slots after the payee hold the other bank and the remark, in either order."""

    def read(t: Text) -> Column:
        a, b = slot(4)(t), slot(5)(t)
        swapped = looks_like_bank(b) & ~looks_like_bank(a)
        clear = looks_like_bank(a) != looks_like_bank(b)
        if which == "bank":
            return F.when(swapped, b).otherwise(a)
        return F.when(swapped, a).when(clear, b).otherwise(F.when(looks_like_bank(a), "").otherwise(b))

    return read


def _bob_handle(t: Text) -> Column:
    """The first of three slots with an @, or a handle that was cut before it."""
    found = F.get(F.filter(F.array(slot(3)(t), slot(4)(t), slot(5)(t)), lambda x: F.contains(x, F.lit("@"))), F.lit(0))
    cut = slot(4)(t)
    return F.coalesce(found, F.when((F.upper(cut) != "UPI") & ~F.contains(cut, F.lit(":")), cut), F.lit(""))


_ATM = Form("ATM", begins=("ATW",), holds=("ATM",))
_P2X = {"ref": slot(2), "payee": slot(3), "bank": _axis_slot("bank"), "remarks": _axis_slot("remarks")}
_TFR_UPI, _TFR_NEFT = r"(?i)(?:WDL|DEP)\s+TFR\s+UPI/(?:DR|CR)/([^/]*)/([^/]*)/[^/]*/([^/]*)", r"(?i)(?:WDL|DEP)\s+TFR\s+NEFT\*[^*]*\*([^*]*)\*([^0-9]*)"
_MANDATE = r"(?i)CMP\s+MANDATE\s+DEBIT\s+(.+?)(?:\s*-\s*DD)?$"
#: Fixed: the forms of each bank, in order.
FORMS: dict[str, tuple[Form, ...]] = {
    "SBI": (
        Form("UPI", pattern=_TFR_UPI, fields={"ref": part(_TFR_UPI, 1), "payee": part(_TFR_UPI, 2), "vpa": part(_TFR_UPI, 3)}),
        Form("NEFT", pattern=_TFR_NEFT, fields={"ref": part(_TFR_NEFT, 1), "payee": part(_TFR_NEFT, 2)}),
        Form("ACH", pattern=r"(?i)\bACHDr\s+\d*\s*(.+)$", fields={"payee": part(r"(?i)\bACHDr\s+\d*\s*(.+)$")}),
        Form("NACH", pattern=_MANDATE, fields={"payee": part(_MANDATE)}),
        Form("UPI", holds=("TRANSFER-UPI",), fields={"ref": slot(2, least=4), "payee": slot(3, least=4), "vpa": slot(5), "remarks": slot(6)}),
        Form("NEFT", begins=("NEFT",)), Form("ECS", begins=("ECS",), holds=("ECS DR", "ECS CR")), Form("NACH", holds=("NACH",)), Form("IMPS", holds=("IMPS",)), _ATM,
    ),
    "ICICI": (
        Form("UPI", begins=("UPI/",), fields={"ref": slot(1, least=3), "payee": slot(1, least=3), "remarks": slot(2), "vpa": slot(3)}),
        Form("NEFT", begins=("BIL/NEFT/",), fields={"ref": slot(2, least=4), "payee": slot(3)}), Form("IMPS", begins=("MMT/IMPS/",), fields={"ref": slot(2, least=4), "payee": slot(3)}),
        Form("ACH", begins=("ACH/",), fields={"payee": slot(1), "ref": slot(2)}), Form("EBA_MF", begins=("EBA/MFP-",), fields={"ref": whole}), Form("EBA_EQ", begins=("EBA/EQ TRADE",), fields={"ref": whole}),
        Form("ATM", begins=("CAM/", "NFS/CASH WDL")), Form("CMS", begins=("CMS/",), fields={"ref": slot(1)}), Form("CLG", begins=("CLG/",), fields={"payee": slot(1)}),
        Form("ONLINE", begins=("BIL/ONL/",), fields={"ref": slot(2, least=4), "payee": slot(3)}), Form("NEFT", begins=("NEFT-",), fields={"ref": slot(1, "-", 3), "payee": slot(2, "-")}),
        Form("INTEREST", holds=("INT.PD:", "INTEREST")), Form("GOVT_SCHEME", holds=("PMJJBY", "PMSBY")),
    ),
    "Axis": (
        Form("UPI", begins=("UPI/P2M/",), fields=_P2X, flags=("is_p2m",)), Form("UPI", begins=("UPI/P2A/",), fields=_P2X, flags=("is_p2a",)),
        Form("UPI", begins=("UPI/",), fields={"ref": slot(1, least=3), "payee": slot(2), "vpa": slot(3)}), Form("NACH", begins=("NACH DR-",), fields={"payee": rest(8)}),
        Form("ACH", begins=("ACH-CR-",), fields={"payee": slot(2, "-"), "remarks": rest(7)}), Form("ACH", begins=("ACH-DR-",), fields={"payee": slot(2, "-")}), _ATM,
    ),
    "Bank Of India": (
        Form("UPI", begins=("UPI-",), fields={"payee": slot(1, "-", 3), "vpa": slot(2, "-"), "ref": slot(3, "-")}), Form("UPI", begins=("UPI/",), fields={"ref": slot(1), "remarks": slot(2)}),
        Form("ECS", begins=("ECS/",), fields={"payee": slot(1)}), Form("ATM", begins=("CWDR",), fields={"ref": lambda t: F.trim(F.coalesce(F.get(F.filter(t.fields("/"), lambda x: F.trim(x) != ""), F.lit(1)), F.lit("")))}),
        Form("ECS", begins=("ECS-",), fields={"payee": lambda t: F.coalesce(F.nullif(F.regexp_extract(rest(4)(t), "^([A-Za-z]+)", 1), F.lit("")), rest(4)(t)), "remarks": rest(4)}),
        Form("LOAN", begins=("LOAN RECO",), fields={"remarks": stripped}), Form("CASH", begins=("BY CASH", "TO CASH")), Form("CHEQUE", begins=("BY CLG", "TO CLG")), Form("INTEREST", holds=("INT CREDIT", "INT.PD")), Form("CHARGES", holds=("CHARGES",)),
        _ATM, Form("", shortest=30, fields={"payee": stripped}),
    ),
    "Union": (
        Form("UPI", begins=("UPIAB/",), fields={"ref": slot(1), "payee": slot(3), "vpa": slot(5)}), Form("UPI", begins=("UPI/",), fields={"ref": slot(1), "payee": slot(2), "remarks": slot(3)}),
        Form("NEFT", begins=("NEFT:", "NEFT-"), fields={"remarks": rest(5)}), Form("ACH", begins=("APB/",), fields={"ref": slot(2), "remarks": slot(3)}), Form("NACH", begins=("NACH-",), fields={"payee": slot(1, "-")}),
        Form("INTEREST", holds=(":INT.PD:",)), Form("CHARGES", holds=("CHARGES", "SMS CHARGE")), _ATM,
    ),
    "BOB": (
        Form("UPI", begins=("UPI/",), fields={"ref": slot(1), "vpa": _bob_handle, "payee": lambda t: F.substring_index(_bob_handle(t), "@", 1), "remarks": slot(5)}),
        Form("NEFT", begins=("NEFT-",), fields={"ref": slot(1, "-", 3), "payee": slot(2, "-")}), Form("RTGS", begins=("RTGS-",), fields={"ref": slot(1, "-", 3), "payee": slot(2, "-")}), Form("ATM", begins=("ATM/",), holds=("ATM/CASH",)),
        Form("ECS", begins=("ECS DR-",), fields={"payee": rest(7)}), Form("INTEREST", holds=(":INT.PD:",)), Form("CHARGES", holds=("SMS CHARGE",)), _ATM,
    ),
}
_BLANK = Form("")


def by_forms(bank: str, t: Text) -> Column:
    """The fields of a bank's first fitting form."""
    out = None
    for form in FORMS[bank]:
        out = F.when(form.test(t), form.read(t)) if out is None else out.when(form.test(t), form.read(t))
    return out.otherwise(_BLANK.read(t))


def _of_bank(bank: Column, t: Text) -> Column:
    out = None
    for name in FORMS:
        out = F.when(bank == name, by_forms(name, t)) if out is None else out.when(bank == name, by_forms(name, t))
    return out.otherwise(_BLANK.read(t))


def _first(xs: Column) -> Column:
    return F.coalesce(F.get(xs, F.lit(0)), F.lit(""))


def _rail(u: Column) -> Column:
    """The rail of the first word that the capitals hold."""
    rail = None
    for word, name in RAIL_WORDS:
        test = F.contains(u, F.lit(word))
        rail = F.when(test, name) if rail is None else rail.when(test, name)
    return F.coalesce(rail, F.lit(""))


def _counts(d: Column) -> list[Column]:
    return [F.length(d) - F.length(F.replace(d, F.lit(c), F.lit(""))) for c in "/-*:"]


def _cut(d: Column, counts: list[Column], most: Column) -> Column:
    """The fields between the most frequent delimiter, if there are two of it or more."""
    cut = None
    for c, n in zip("/-*:", counts, strict=True):
        own = F.split(F.translate(d, c, "\x01"), "\x01")
        cut = F.when(n == most, own) if cut is None else cut.when(n == most, own)
    return F.when(most >= 2, cut).otherwise(F.array(d))


def _look(fields: Column) -> Column:
    """The handle, the fields that read like names and the number among fields."""
    letters = lambda x: F.length(F.regexp_replace(x, r"[^\p{L}]+", ""))
    # Three letters or more, and more than half of the field; a NO_PAYEE has eight, and a line break at most.
    is_name = lambda x: (F.length(x) >= 3) & ~F.contains(x, F.lit("@")) & (letters(x) >= F.greatest(F.lit(3), F.shiftright(F.length(x), 1) + 1)) & ((F.length(x) > 10) | ~x.rlike(NO_PAYEE)) & ~looks_like_bank(x)
    vpa = _first(F.filter(F.transform(F.filter(fields, lambda x: F.contains(x, F.lit("@"))), lambda x: F.regexp_extract(x, VPA, 0)), lambda x: x != ""))
    return F.struct(vpa.alias("vpa"), F.filter(fields, is_name).alias("named"), _first(F.filter(fields, lambda x: x.rlike(NUMBER))).alias("ref"))


def _told(d: Column, rail: Column, seen: Column) -> Column:
    vpa, named = seen["vpa"], seen["named"]
    payee = F.when(F.size(named) > 0, F.substring(_first(named), 1, 40)).when(vpa != "", F.substring(F.substring_index(vpa, "@", 1), 1, 40)).when(F.length(d) <= 30, d).otherwise("")
    remarks = F.when(F.size(named) > 1, F.substring(F.element_at(named, -1), 1, 40)).otherwise("")
    own = {"rail": rail, "ref": seen["ref"], "payee": payee, "vpa": vpa, "remarks": remarks, "bank": F.lit("")}
    return F.struct(*[F.coalesce(own[f], F.lit("")).alias(f) for f in FIELDS], *[F.lit(False).alias(f) for f in FLAGS])


def by_tokens(narration: Column) -> Column:
    """Any narration: its rail by a word, its delimiter by count; the handle and the number by their look; the payee is
    the first field that reads like a name, and the last one the remark."""

    def tokens(d: Column) -> Column:
        counts = _counts(d)
        fields = F.transform(_cut(d, counts, F.greatest(*counts)), lambda x: F.trim(x))
        return once(fields, lambda fields: once(_look(fields), lambda seen: _told(d, _rail(F.upper(d)), seen)))

    return once(F.trim(narration), tokens)


def _whole(own: Column) -> Column:
    return (own["rail"] != "") & (own["payee"] != "")


def _filled(own: Column, other: Column) -> Column:
    return F.struct(*[F.coalesce(F.nullif(own[f], F.lit("")), other[f]).alias(f) for f in FIELDS], *[own[f].alias(f) for f in FLAGS])


def parse(bank: Column, narration: Column) -> Column:
    """The fields of a narration by its bank's forms; if rail or payee is missing, blanks are filled by the general
    reader, which alone reads other banks. Null counts as empty."""
    d = F.coalesce(narration, F.lit(""))
    return once(_of_bank(bank, Text.of(d)), lambda own: F.when(_whole(own), own).otherwise(once(by_tokens(d), lambda other: _filled(own, other))))


def parsed(rows: DataFrame, bank: str = "bank_name", narration: str = "description") -> DataFrame:
    """rows with p, what `parse` reads of them. Steps that hold a function over an array run outside of the stage's one
    method, so that their long CASEs are split; what the general reader looks at is null where it isn't asked."""
    c = F.col
    rest = rows.columns
    text = Text(c("__d"), c("__u"), lambda sep: c({"/": "__slash", "-": "__dash"}[sep]))
    cut = rows.select(*rest, F.coalesce(narration, F.lit("")).alias("__d"))
    cut = cut.select(*rest, "__d", F.upper("__d").alias("__u"), F.split("__d", "/").alias("__slash"), F.split("__d", "-").alias("__dash"))
    own = cut.select(*rest, "__d", "__slash", "__dash", _of_bank(c(bank), text).alias("__own"))
    asked = own.select(*rest, "__own", (F.size("__slash") - 1).alias("__0"), (F.size("__dash") - 1).alias("__1"), F.when(~_whole(c("__own")), F.trim("__d")).alias("__t"))
    count = lambda x: F.length("__t") - F.length(F.replace("__t", F.lit(x), F.lit("")))
    counted = asked.select(*rest, "__own", "__t", "__0", "__1", count("*").alias("__2"), count(":").alias("__3"))
    counts = [c(f"__{i}") for i in range(4)]
    fields = counted.select(*rest, "__own", "__t", F.upper("__t").alias("__tu"), F.when(c("__t").isNotNull(), F.transform(_cut(c("__t"), counts, F.greatest(*counts)), lambda x: F.trim(x))).alias("__fields"))
    seen = fields.select(*rest, "__own", "__t", F.when(c("__t").isNotNull(), _rail(c("__tu"))).alias("__rail"), F.when(c("__t").isNotNull(), _look(c("__fields"))).alias("__seen"))
    told = seen.select(*rest, "__own", F.when(c("__t").isNotNull(), _told(c("__t"), c("__rail"), c("__seen"))).alias("__other"))
    p = told.select(*rest, F.when(c("__other").isNull(), c("__own")).otherwise(_filled(c("__own"), c("__other"))).alias("__p"))
    # Behind a generator no filter on p is written out into these steps, where it would grow with the product of all.
    return p.select(*rest, F.inline(F.array(F.struct(c("__p").alias("p")))))
