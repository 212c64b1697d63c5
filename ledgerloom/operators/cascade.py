"""The whole rule cascade over narrations: bank rules, handle directory, keywords, fuzzy names, rails, default.

Each tier is a struct that is null where it doesn't know the row, and the first one that does decides. Keywords are
looked up for the narration and for the payee at once, where rows stand (see dictionary); employers known by their
salaries are one array for each account. It joins rows as they come, before anything is made of them, and all that
follows is made in steps, each a projection of its own (see narration)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.text import holds
from ledgerloom.operators import dictionary, labels, narration

A = "account_id"
NAMES = ("category", "subcategory", "merchant", "needs_wants", "confidence", "method", "rule")
#: Fixed: patterns of rails, by bank.
ATM = {
    "SBI": "ATW|ATM-CASH|CWDR|SBI ATM", "ICICI": "^CAM/.*/CASH WDL", "Axis": "ATW|ATM-CASH|AXIS ATM", "Bank Of India": "ATW|BOI ATM|CWDR", "Union": "ATW|UNION ATM|CWDR", "BOB": "ATW|BOB ATM|CWDR", "Punjab National Bank": "ATW|PUNB ATM|CWDR",
    "YES Bank": "ATW|CSW|ATD|ATI|YES BANK ATM", "Bank Of Maharashtra": "ATW|MAHB ATM|CWDR", "Federal Bank": "ATW|FEDERAL ATM", "Indian Overseas Bank": "ATW|ATM-IOB", "IndusInd Bank": "ATW|INDUSIND ATM", "Canara Bank": "ATW|CANARA ATM", "IDBI Bank": "ATW|IDBI ATM",
}
FASTAG = {"SBI": "SBI", "ICICI": "ICIC", "Axis": "UTIB", "Bank Of India": "BKID", "Union": "UBIN", "BOB": "BARB", "Punjab National Bank": "PUNB", "YES Bank": "YESB", "Bank Of Maharashtra": "MAHB", "Federal Bank": "FDRL", "Indian Overseas Bank": "IOBA", "IndusInd Bank": "INDB", "Canara Bank": "CNRB", "IDBI Bank": "IBKL"}
INTEREST, CHARGE, SCHEME, RETURNED, FOREX, ONLINE, CHEQUE = r"Int\.Pd:", "DCardfee|AdminCharge|CGST|SGST", "PMJJBY|PMSBY", "^NEFT-RETURN-", r"^[A-Z]{3}SXR\d+:", "^BIL/ONL/", "^CLG/"
#: Fixed: a bank's own words by what they mean, in the order in which they are looked for.
BANK_WORDS = {
    "SBI": {"hl_emi": ["SBIHLEMI", "ECS-SBIHOME"], "insurance": ["SBI LIFE"], "cc_payment": ["SBICARD", "CREDIT CARD BILL"], "pl": ["ECS-SBI PL"], "investment": ["BILLDESK-MF", "NACH-MF"]},
    "ICICI": {"hl_emi": ["ICICIHLEMI", "ACH DEBIT-ICICI HFC"], "insurance": ["ICICI PRU LIFE", "ICICI LOMBARD"], "cc_payment": ["ICICI CREDIT CARD"], "investment": ["ICICI DIRECT", "ICICI SECURITIES", "ICICI DIRECT MF"]},
    "Axis": {"hl_emi": ["NACH DR-AXIS HL"], "insurance": ["MAX LIFE"], "cc_payment": ["AXIS CREDIT CARD"], "pl": ["NACH DR-AXIS PL"]},
    "Bank Of India": {"hl_emi": ["ECS/BOI HL"], "cc_payment": ["BOI CREDIT CARD"], "pl": ["ECS/BOI PL"]},
    "Union": {"hl_emi": ["NACH-UNION HL"], "cc_payment": ["UNION CREDIT CARD"], "pl": ["NACH-UNION PL"]},
    "BOB": {"hl_emi": ["ECS DR-BOB HL"], "cc_payment": ["BOB CREDIT CARD"], "pl": ["ECS DR-BOB PL"]},
    "Punjab National Bank": {"cc_payment": ["PNB CREDIT CARD"], "hl_emi": ["PNB HOUSING"]}, "YES Bank": {"cc_payment": ["YES BANK CREDIT CARD"]}, "IndusInd Bank": {"cc_payment": ["INDUSIND CREDIT CARD"]},
}
#: Fixed: handles of pension and fund registrars, and how narrations of transfers begin.
REGISTRARS = "NPSCAMS|NPS TRUST|NSDL-NPS|PROTEAN|CAMSONLINE|KFINTECH|CAMS "
TRANSFERS = r"^(BIL/NEFT/|NEFT/|NEFT-|MMT/IMPS/|IMPS/|RTGS/|INF/|BIL/ONL/|UPI/)|TRANSFER-UPI|^(?:WDL|DEP)\s+TFR\s+"
#: Fixed: what makes a credit look like a salary.
SALARY = "SALARY|PAYROLL|COSAL|STIPEND|^ACH/|^ACH-CR-|^NACH"


@dataclass
class Rules:
    """words: the keyword dictionary, with categories Investment, Income, Banking and Expense in that order of entries;
    merchants: the canonical names of keys that stand in a narration; handles: (part of a VPA, category, subcategory,
    needs or wants, merchant, confidence), in order."""

    words: dictionary.Dictionary
    merchants: dict[str, str] = field(default_factory=dict)
    handles: tuple[tuple[str, str, str, str, str, float], ...] = ()

    @cached_property
    def bank_words(self) -> dictionary.Dictionary:
        return dictionary.Dictionary([(w, f"{bank}|{kind}", kind, "") for bank, kinds in BANK_WORDS.items() for kind, ws in kinds.items() for w in ws])

    @cached_property
    def names(self) -> dictionary.Dictionary:
        return dictionary.Dictionary([(k, "merchant", name, "") for k, name in self.merchants.items()] or [("\x00", "merchant", "", "")])


def _verdict(category: Column | str, subcategory: Column | str, merchant: Column | str, label: Column | str, sure: Column | float, method: str, rule: Column | str) -> Column:
    values = [v if isinstance(v, Column) else F.lit(v) for v in (category, subcategory, merchant, label, sure, method, rule)]
    return F.struct(*[(v.cast("double") if n == "confidence" else v.cast("string")).alias(n) for n, v in zip(NAMES, values, strict=True)])


def _of_bank(table: dict[str, str], u: Column, prefix: str = "") -> Column:
    """Whether the narration matches its bank's pattern."""
    out = F.lit(False)
    for bank, pattern in table.items():
        out = F.when(F.col("bank_name") == bank, u.rlike(f"(?i){prefix}{pattern}")).otherwise(out)
    return out


def salary_payers(rows: DataFrame, least: int = 2) -> DataFrame:
    """(account_id, payers): payees of `least` or more salary-like credits of an account, with names of six characters
    or more that are no number. rows: account_id, bank_name, description, credit_c. Only such credits are parsed."""
    # One look at the narration: a filter is pushed down to where it is made, and makes it for each look.
    credits = narration.parsed(rows.where((F.col("credit_c") > 0) & F.upper("description").rlike(SALARY)).select(A, "bank_name", "description")).select(A, F.upper(F.trim(F.col("p.payee"))).alias("payer"))
    named = credits.where((F.length("payer") >= 6) & ~F.replace("payer", F.lit(" "), F.lit("")).rlike(r"^\d+$"))
    return named.groupBy(A, "payer").agg(F.count("*").alias("n")).where(F.col("n") >= least).groupBy(A).agg(F.array_sort(F.collect_list("payer")).alias("payers"))


_ENTRY = "struct<keyword: string, k_category: string, k_subcategory: string, k_label: string, rank: int>"


def _keywords(spark: SparkSession, rules: Rules) -> Column:
    """Of a row (p parsed, `only`: 1 if it can be no expense, 2 no income, 3 neither): kd, kp, the keyword of the narration
    and of the payee that its direction allows; kb, its bank's own word; kt, the keyword of which the payee is a beginning
    cut short; entity, payee_entity, the merchants' names or ''. A text is stepped through once for all dictionaries."""
    words, banks, names = rules.words, rules.bank_words, rules.names
    every, (_, at_bank, at_name) = dictionary.together(words, banks, names)
    codes = {"Expense": 1, "Income": 2}
    forbidden = np.array([codes.get(c, 0) for c in words.category], np.int8)
    own_bank = [c.split("|")[0] for c in banks.category]
    known = list(dict.fromkeys(own_bank))
    kinds = list(dict.fromkeys(e[2] for e in banks.entries))
    bank_of = np.array([known.index(b) for b in own_bank], np.int64)
    # A bank's words by kind, and the longest of a kind first.
    place = np.array([kinds.index(e[2]) * len(banks.entries) + banks._place[i] for i, e in enumerate(banks.entries)], np.int64)
    shared = spark.sparkContext.broadcast((every, words.values, banks.values, names.values.field("k_subcategory"), dictionary.truncated(words), forbidden, known, bank_of, place))

    @F.arrow_udf(f"struct<kd: {_ENTRY}, kp: {_ENTRY}, kb: {_ENTRY}, kt: {_ENTRY}, entity: string, payee_entity: string>")
    def found(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        every, words, banks, names, cut, forbidden, known, bank_of, place = shared.value
        take = lambda values, entry: values.take(pa.array(entry, pa.int64(), mask=entry < 0))

        for texts, payees, bank, only in batches:
            n, only = len(texts), only.to_numpy(zero_copy_only=False)

            def told(texts: pa.Array, n: int = n, only: np.ndarray = only) -> tuple[np.ndarray, np.ndarray, pa.Array, pa.Array]:
                row, entry = every.found_in(texts)
                mine = entry < at_bank
                r, e = row[mine], entry[mine]
                free = (forbidden[e] & only[r]) == 0
                word = dictionary.first_of(r[free], e[free], n)
                mine = entry >= at_name
                name = dictionary.first_of(row[mine], entry[mine] - at_name, n)
                return row, entry, take(words, word), pc.fill_null(take(names, name), "")

            row, entry, kd, entity = told(texts)
            _, _, kp, payee_entity = told(payees)
            own = pc.fill_null(pc.index_in(bank, pa.array(known)), -1).to_numpy(zero_copy_only=False)
            mine = (entry >= at_bank) & (entry < at_name)
            r, e = row[mine], entry[mine] - at_bank
            r, e = r[bank_of[e] == own[r]], e[bank_of[e] == own[r]]
            order = np.lexsort((place[e], r))
            kb = take(banks, dictionary.first_of(r[order], e[order], n))
            kt = words.take(pa.array([cut.get((x or "").strip().upper()) for x in payees.to_pylist()], pa.int64()))
            yield pa.StructArray.from_arrays([kd, kp, kb, kt, entity, payee_entity], ["kd", "kp", "kb", "kt", "entity", "payee_entity"])

    return found(F.col("description"), F.col("p.payee"), F.col("bank_name"), F.col("only"))


def _bank_rules(kd: Column, kp: Column, kb: Column) -> list[Column]:
    """Tier one, in order. kd, kp: the keyword of the narration and of the payee; kb: the bank's own word."""
    d, u, p, debit, credit, bank = F.col("description"), F.col("u"), F.col("p"), F.col("debit_c") > 0, F.col("credit_c") > 0, F.col("bank_name")
    icici, method = bank == "ICICI", "bank_rule"
    is_ = lambda pattern: d.rlike(f"(?i){pattern}")
    word = lambda k, merchant, sure, rule: _verdict(k["k_category"], k["k_subcategory"], merchant, k["k_label"], sure, method, rule)
    payee = F.trim(p["payee"])
    cheque = F.when(kd.isNotNull(), word(kd, F.coalesce(F.nullif(payee, F.lit("")), F.col("entity")), 0.90, "cheque_payee")).otherwise(
        _verdict(F.when(debit, "Expense").otherwise("Income"), "Cheque", payee, F.when(debit, "Unknown").otherwise("Not Applicable"), 0.95, method, "cheque"))
    kind = kb["k_subcategory"]
    own = F.when(kind.isin("hl_emi", "pl"), _verdict("Expense", "Loan / EMI", "", "Need", 0.96, method, "bank_loan")).when(kind == "insurance", _verdict("Expense", "Insurance", "", "Need", 0.96, method, "bank_insurance"))
    own = own.when(kind == "cc_payment", _verdict("Expense", "Loan / EMI", kb["keyword"], "Need", 0.96, method, "bank_card")).when(kind == "investment", _verdict("Investment", "Equity Trading", kb["keyword"], "N/A", 0.96, method, "bank_investment"))
    return [
        F.when(icici & u.startswith("EBA/MFP-"), _verdict("Investment", "Mutual Funds / SIP", "ICICI Direct", "N/A", 0.98, method, "fund")),
        F.when(icici & u.startswith("EBA/EQ TRADE"), _verdict("Investment", "Equity Trading", "ICICI Direct", "N/A", 0.98, method, "equity")),
        F.when((bank == "Axis") & p["is_p2m"] & kp.isNotNull(), word(kp, F.col("payee_entity"), 0.95, "merchant_payee")),
        F.when((p["rail"] == "ACH") & credit, _verdict("Income", "Salary", payee, "N/A", 0.95, method, "ach_credit")),
        F.when((p["rail"] == "ACH") & debit & kp.isNotNull(), word(kp, payee, 0.95, "ach_payee")),
        F.when(_of_bank(ATM, d), _verdict("Banking", "ATM Withdrawal", "", "N/A", 0.99, method, "atm")),
        F.when(p["rail"] == "ATM", _verdict("Banking", "ATM Withdrawal", "", "N/A", 0.97, method, "atm_rail")),
        F.when(_of_bank(FASTAG, d, "NETC FASTAG-"), _verdict("Expense", "Metro / Bus / Toll / Parking", "FASTag", "Need", 0.98, method, "fastag")),
        F.when(icici & is_(INTEREST), _verdict("Income", "Interest", "", "N/A", 0.99, method, "interest")),
        F.when(icici & is_(CHARGE), _verdict("Banking", "Bank Charges", "", "N/A", 0.97, method, "charge")),
        F.when(icici & is_(SCHEME), _verdict("Expense", "Insurance", "", "Need", 0.97, method, "scheme")),
        F.when(icici & is_(RETURNED), _verdict("Income", "Refund / Reversal", "", "N/A", 0.97, method, "neft_return")),
        F.when(icici & is_(FOREX), _verdict(F.when(credit, "Income").otherwise("Expense"), "Forex", "", "N/A", 0.95, method, "forex")),
        F.when(icici & is_(ONLINE) & kd.isNotNull(), word(kd, F.col("entity"), 0.95, "online_payment")),
        F.when(icici & is_(CHEQUE), cheque),
        own,
    ]


def _handle(handles: tuple) -> Column:
    """The directory entry of the first handle that the user or the handle of the narration's VPA (vpa) holds; a credit
    from a merchant is a refund."""
    vpa = F.col("vpa")
    user, host, out = F.substring_index(vpa, "@", 1), F.substring_index(vpa, "@", -1), None
    for part, category, subcategory, label, merchant, sure in handles:
        met = (vpa != "") & (F.contains(user, F.lit(part)) | F.contains(host, F.lit(part)))
        v = _verdict(category, subcategory, merchant, label, sure, "vpa_directory", part)
        if category == "Expense":
            v = F.when(F.col("credit_c") > 0, _verdict("Income", f"{merchant} Refund", merchant, "Not Applicable", sure, "vpa_directory", part)).otherwise(v)
        out = F.when(met, v) if out is None else out.when(met, v)
    return out if out is not None else F.lit(None).cast(", ".join(["struct<" + ", ".join(f"{n}: {'double' if n == 'confidence' else 'string'}" for n in NAMES) + ">"]))


def _rails(kp: Column, kt: Column) -> list[Column]:
    """What is left to say of a transfer (rail), in order. kt: the keyword of which the payee is a beginning cut short;
    purpose: what its remark says."""
    u, p, debit, credit = F.col("u"), F.col("p"), F.col("debit_c") > 0, F.col("credit_c") > 0
    payee, method = F.trim(p["payee"]), "rail_transfer_rule"
    number = F.replace(F.replace(payee, F.lit("."), F.lit("")), F.lit(" "), F.lit("")).rlike(r"^\d+$")
    purpose, label = F.col("purpose"), F.coalesce(labels.remark_label(p["remarks"]), F.lit("Unknown"))
    rail = F.col("rail")
    person = p["is_p2a"] | ((p["rail"] == "UPI") & ~p["is_p2m"] & (payee != "") & ~F.replace(payee, F.lit("."), F.lit("")).rlike(r"^\d+$"))
    one = lambda test, v: F.when(rail & test, v)
    return [
        F.when(holds(u, REGISTRARS), _verdict("Investment", F.when(F.contains(u, F.lit("NPS")), "NPS").otherwise("Mutual Funds / SIP"), "", "Not Applicable", 0.92, "bank_rule", "investment_handle")),
        F.when(credit & F.exists("payers", lambda x: F.contains(u, x)), _verdict("Income", "Salary", payee, "Not Applicable", 0.88, "bank_rule", "known_salary_payer")),
        one(debit & (kp["k_category"] == "Expense"), _verdict(kp["k_category"], kp["k_subcategory"], F.col("payee_entity"), kp["k_label"], 0.90, method, "payee_merchant")),
        one(debit & (kt["k_category"] == "Expense"), _verdict(kt["k_category"], kt["k_subcategory"], kt["keyword"], kt["k_label"], 0.70, method, "payee_truncated")),
        one(person & debit & purpose.isNotNull(), _verdict("Expense", purpose, payee, label, 0.72, method, "person_remark")),
        one(person, _verdict("Transfer", F.when(credit, "P2P Transfer In").otherwise("P2P Transfer Out"), payee, "Not Applicable", 0.80, method, "person")),
        one(p["is_p2m"], _verdict("Expense", F.coalesce(purpose, F.lit("Merchant Payment (UPI)")), payee, label, F.when(purpose.isNotNull(), 0.75).otherwise(0.60), method, F.when(purpose.isNotNull(), "merchant_remark").otherwise("merchant"))),
        one((payee != "") & ~number, _verdict("Transfer", F.when(credit, "Bank Transfer In").otherwise("Bank Transfer Out"), payee, "N/A", 0.70, method, "named_transfer")),
        one(F.lit(True), _verdict(F.when(credit, "Income").otherwise("Expense"), F.when(credit, "Other Income").otherwise("Other Expense"), payee, "N/A", 0.35, method, "rail_only")),
    ]


def classify(rows: DataFrame, rules: Rules, least: int = 2) -> DataFrame:
    """rows with category, subcategory, merchant, needs_wants, confidence, method and rule, and the parsed narration p.

    rows: account_id, bank_name, description, debit_c, credit_c, and payers, if salary_payers has joined them already.
    Keywords that a row's direction forbids are no candidates. An employer needs `least` salary-like credits. Null
    narrations count as empty."""
    out = [c for c in rows.columns if c != "payers"]
    own = rows if "payers" in rows.columns else rows.join(salary_payers(rows, least), A, "left").select(*rows.columns, "payers")
    own = own.withColumn("description", F.coalesce("description", F.lit("")))
    debit, credit = F.col("debit_c") > 0, F.col("credit_c") > 0
    only = F.when(F.coalesce(credit & ~debit, F.lit(True)), 1).otherwise(0) + F.when(F.coalesce(debit & ~credit, F.lit(True)), 2).otherwise(0)
    found = narration.parsed(own).withColumn("only", only.cast("byte"))
    known = found.select(*out, "payers", "p", _keywords(rows.sparkSession, rules).alias("k"))
    u, vpa = F.upper("description"), F.when(F.contains("description", F.lit("@")), F.lower(F.regexp_extract("description", narration.VPA, 0))).otherwise("")
    # The test of payers holds a function over an array, by which the long CASEs of this step and the next are split.
    known = known.select(*out, "payers", "p", *[F.col(f"k.{c}").alias(c) for c in ("kd", "kp", "kb", "kt", "entity", "payee_entity")], u.alias("u"), vpa.alias("vpa"))
    known = known.select("*", F.col("u").rlike(TRANSFERS).alias("rail"), labels.remark_subcategory(F.col("p.remarks")).alias("purpose"))
    kd, kp, kb, kt = (F.col(c) for c in ("kd", "kp", "kb", "kt"))
    keyword = F.when(kd.isNotNull(), _verdict(kd["k_category"], kd["k_subcategory"], F.when(kd["k_category"] == "Banking", "").otherwise(F.col("entity")), kd["k_label"], 0.90, "keyword", kd["keyword"]))
    none = _verdict("Uncategorized", "Unknown", "", "Unknown", 0.0, "none", "")
    tiers = [*_bank_rules(kd, kp, kb), _handle(rules.handles), keyword, *_rails(kp, kt), none]
    return known.select(*out, "p", F.coalesce(*tiers).alias("verdict")).select(*out, "p", F.inline(F.array("verdict")))
