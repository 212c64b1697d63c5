"""Readers, the ledger projections over relational tables, and sinks."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.operators import scan

#: The canonical ledger as it is exchanged in files.
STATEMENT = T.StructType([T.StructField("date", T.DateType()), T.StructField("description", T.StringType()), T.StructField("debit", T.DecimalType(18, 2)), T.StructField("credit", T.DecimalType(18, 2)), T.StructField("balance", T.DecimalType(18, 2))])

#: How a transaction of the relational tables reads on a statement; valid in Spark and in DuckDB.
NARRATION = """case mod(l_orderkey + l_linenumber + l_partkey, 12)
when 0 then 'UPI/P2M/' || cast(l_orderkey as string) || '/SUPPLIER ' || cast(l_suppkey as string) || '/Paytm Bank/' || p_name
when 1 then 'UPI/SUPPLIER ' || cast(l_suppkey as string) || '/' || cast(l_orderkey as string) || '/' || p_name
when 2 then 'UPI-SUPPLIER ' || cast(l_suppkey as string) || '-s' || cast(l_suppkey as string) || '@okaxis-' || cast(l_orderkey as string)
when 3 then 'NEFT-N' || lpad(cast(l_orderkey as string), 12, '0') || '-SUPPLIER ' || cast(l_suppkey as string) || '-Union Bank'
when 4 then 'MMT/IMPS/' || cast(l_orderkey as string) || '/SUPPLIER ' || cast(l_suppkey as string) || '/HDFC0000001'
when 5 then 'ACH/LENDER ' || cast(mod(l_suppkey, 9) as string) || ' FINANCE/' || cast(l_orderkey as string) || '/EMI'
when 6 then 'CAM/BRANCH ' || cast(mod(l_suppkey, 20) as string) || '/CASH WDL/' || cast(l_linenumber as string)
when 7 then 'CLG/SUPPLIER ' || cast(l_suppkey as string) || '/BANK - ' || cast(l_partkey as string)
when 8 then 'TO TRANSFER-UPI/DR/' || cast(l_orderkey as string) || '/SUPPLIER ' || cast(l_suppkey as string) || '/SBIN/s' || cast(l_suppkey as string) || '@oksbi/' || p_name
when 9 then 'SALARY EMPLOYER ' || cast(mod(l_suppkey, 15) as string) || ' PAYROLL'
when 10 then 'EBA/MFP-' || cast(l_orderkey as string) || '-SIP-' || p_type
else 'ECS RETURN CHARGES ' || cast(l_suppkey as string) end"""
#: Of a part, only the text that a row's narration holds, as `item`: so much less than narrations travels to accounts.
ITEM = "case mod(l_orderkey + l_linenumber + l_partkey, 12) when 0 then p_name when 1 then p_name when 8 then p_name when 10 then p_type end"
#: Which columns order a day's rows; rows equal in all of them are interchangeable.
ORDER = "d, l_orderkey, l_linenumber, l_partkey, l_suppkey, amount_c, is_credit, l_returnflag"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of input files for each partition of a placing that the session's number of partitions would make too large.
SHARE = 8 << 20
#: Bytes of files up to which a table that is joined with is likely broadcast, so that the other side isn't placed for it.
SMALL = 32 << 20


def file_bytes(rows: DataFrame) -> int:
    """The size of the files that rows are read from."""
    sc = rows.sparkSession.sparkContext
    paths, conf = [sc._jvm.org.apache.hadoop.fs.Path(f) for f in set(rows.inputFiles())], sc._jsc.hadoopConfiguration()
    return sum(x.getFileSystem(conf).getFileStatus(x).getLen() for x in paths)


def parts(rows: DataFrame, share: int = SHARE) -> int:
    """Partitions for a placing of rows: the session's number, or more, one for each `share` bytes of the files that rows
    are read from, so that a task's memory doesn't grow with the tables."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-file_bytes(rows) // share))


def placed(rows: DataFrame, *keys: str, share: int = SHARE) -> DataFrame:
    """rows placed by keys in as many parts as they need; later windows and groups by these and more keys stay in place."""
    return rows.repartition(parts(rows, share), *keys)


def ledger_items(spark: SparkSession, sf_dir: str, narration: bool = True, balance: bool = True, pieces: bool = False, place: bool = False, share: int = SHARE) -> DataFrame:
    """account_id, seq, d, ym, description, debit_c, credit_c, balance_c (cents), counterparty, p_type, is_return.

    One order of rows per account: seq by date, then by all columns. One shuffle on the account serves seq and
    the running balance, and both windows drop out of plans that use neither. Without `narration` (description,
    p_type) or `balance` the join that only they need is left out: every part and customer key is known to
    exist, but Spark can't know, so it would keep an inner join for nothing. With `pieces`, an account's days are
    numbered and summed each by itself and then by what came before, so that no account is one task's work. With
    `place`, rows are placed by account in parts of bounded size (`share` bytes of files), for queries that hold much of a
    part in memory.
    Narrations are put together after that, from the keys that order rows anyway."""
    cents = lambda c: F.round(F.col(c) * 100).cast("long")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    rows = read(spark, sf_dir, "lineitem")
    many = parts(rows) if place else 0
    known = many > int(spark.conf.get("spark.sql.shuffle.partitions"))
    # For joins with large tables, too, there are more parts than the session's.
    at = lambda x, key, other: x.repartition(many, key) if known and file_bytes(other) > SMALL else x
    rows = at(rows, "l_orderkey", orders).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    if narration:
        part = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
        rows = at(rows, "l_partkey", part).join(part, F.col("l_partkey") == F.col("p_partkey"))
    if balance:
        customer = read(spark, sf_dir, "customer").select("c_custkey", cents("c_acctbal").alias("opening_c"))
        rows = at(rows, "o_custkey", customer).join(customer, F.col("o_custkey") == F.col("c_custkey"))
    texts = [F.expr(ITEM).alias("item"), "p_type"] if narration else []
    rows = rows.select(
        F.col("o_custkey").alias("account_id"), F.to_date("l_shipdate").alias("d"), cents("l_extendedprice").alias("amount_c"), (F.col("l_linestatus") == "F").alias("is_credit"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", *texts, *(["opening_c"] if balance else []),
    )
    rows = rows.repartition(parts(read(spark, sf_dir, "lineitem"), share), "account_id") if place else rows
    order = [c.strip() for c in ORDER.split(",")]
    w = Window.partitionBy("account_id").orderBy(*order)
    signed = F.when(F.col("is_credit"), F.col("amount_c")).otherwise(-F.col("amount_c"))
    number = F.row_number().over(w).cast("long").alias("seq")
    if pieces:
        rows = scan.scanned(rows, F.col("d"), order, {"seq": F.lit(1).cast("long")} | ({"moved_c": signed} if balance else {}))
        number = F.col("seq")
    running = (F.col("opening_c") + F.col("moved_c")).alias("balance_c") if pieces and balance else (F.col("opening_c") + F.sum(signed).over(w.rowsBetween(Window.unboundedPreceding, 0))).alias("balance_c") if balance else None
    # Two steps, as what is made beside a window is made before its rows travel.
    rows = rows.select("account_id", number, "d", "amount_c", "is_credit", *([running] if balance else []), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", *(["item", "p_type"] if narration else []))
    return rows.select(
        "account_id", "seq", "d", F.date_format("d", "yyyy-MM").alias("ym"), *([F.expr(NARRATION.replace("p_name", "item").replace("p_type", "item")).alias("description")] if narration else []),
        F.when(F.col("is_credit"), F.lit(0)).otherwise(F.col("amount_c")).cast("long").alias("debit_c"), F.when(F.col("is_credit"), F.col("amount_c")).otherwise(F.lit(0)).cast("long").alias("credit_c"),
        *(["balance_c"] if balance else []), F.concat(F.lit("SUPPLIER "), F.col("l_suppkey").cast("string")).alias("counterparty"), *(["p_type"] if narration else []), (F.col("l_returnflag") == "R").alias("is_return"),
    )


LEDGER_SQL = f"""base as (select o_custkey as account_id, cast(round(c_acctbal * 100) as bigint) as opening_c, cast(l_shipdate as date) as d,
cast(round(l_extendedprice * 100) as bigint) as amount_c, l_linestatus = 'F' as is_credit, {NARRATION} as description,
'SUPPLIER ' || cast(l_suppkey as string) as counterparty, p_type, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag
from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey join customer on o_custkey = c_custkey),
ledger as materialized (select account_id, row_number() over w as seq, d, strftime(d, '%Y-%m') as ym, description,
case when is_credit then 0 else amount_c end as debit_c, case when is_credit then amount_c else 0 end as credit_c,
cast(opening_c + sum(case when is_credit then amount_c else -amount_c end) over (partition by account_id order by {ORDER} rows between unbounded preceding and current row) as bigint) as balance_c,
counterparty, p_type, l_returnflag = 'R' as is_return from base window w as (partition by account_id order by {ORDER}))"""


def ledger_events(spark: SparkSession, sf_dir: str, pieces: bool = False) -> DataFrame:
    """account_id, seq, ts, d, ym, kind, debit_c, credit_c, balance_c: a dense month of activity."""
    credit = F.col("event_type").isin("purchase", "signup")
    amount = F.round(F.col("value") * 100).cast("long")
    rows = read(spark, sf_dir, "events").select(F.col("user_id").alias("account_id"), F.col("event_id").alias("seq"), "ts", F.to_date("ts").alias("d"), F.date_format("ts", "yyyy-MM").alias("ym"), F.col("event_type").alias("kind"), F.when(credit, 0).otherwise(amount).cast("long").alias("debit_c"), F.when(credit, amount).otherwise(0).cast("long").alias("credit_c"))
    if pieces:
        return scan.scanned(rows, F.col("d"), ["ts", "seq"], {"balance_c": F.col("credit_c") - F.col("debit_c")})
    w = Window.partitionBy("account_id").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("balance_c", F.sum(F.col("credit_c") - F.col("debit_c")).over(w))


EVENTS_SQL = """eb as (select user_id as account_id, event_id as seq, ts, cast(ts as date) as d, strftime(ts, '%Y-%m') as ym, event_type as kind,
case when event_type in ('purchase', 'signup') then 0 else cast(round(value * 100) as bigint) end as debit_c,
case when event_type in ('purchase', 'signup') then cast(round(value * 100) as bigint) else 0 end as credit_c from events),
ev as (select *, cast(sum(credit_c - debit_c) over (partition by account_id order by ts, seq rows between unbounded preceding and current row) as bigint) as balance_c from eb)"""


def read_statements(spark: SparkSession, path: str, glob: str = "*.csv") -> DataFrame:
    """Every statement CSV under a folder, with its file in source_file; rows that don't parse keep their text
    in _bad and leave the rest of their file alone."""
    schema = T.StructType([*STATEMENT.fields, T.StructField("_bad", T.StringType())])
    return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").option("pathGlobFilter", glob).csv(path).withColumn("source_file", F.input_file_name())


def merge_statements(statements: Iterable[DataFrame]) -> DataFrame:
    """Rows of several statements (columns of STATEMENT and seq), in date order, each exact repetition once,
    from the first statement that has it; source_no says which."""
    parts = [s.withColumn("source_no", F.lit(i)) for i, s in enumerate(statements)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    w = Window.partitionBy(*(["account_id"] if "account_id" in rows.columns else []), *STATEMENT.fieldNames()).orderBy("source_no", "seq")
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    """Bank templates of a JSON file {bank: {...}} as rows (bank, spec): a configuration of bounded size."""
    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    return spark.createDataFrame([(k, json.dumps(v, sort_keys=True)) for k, v in json.loads(text).items()], "bank string, spec string")


def flatten(df: DataFrame) -> DataFrame:
    """Nested columns as dotted names; arrays and maps as JSON text."""
    columns = []

    def walk(kind: T.DataType, path: tuple[str, ...]) -> None:
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                walk(f.dataType, (*path, f.name))
        else:
            c = F.col(".".join(f"`{p}`" for p in path))
            columns.append((F.to_json(c) if isinstance(kind, T.ArrayType | T.MapType) else c).alias(".".join(path)))

    walk(df.schema, ())
    return df.select(*columns)


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one that spark.checkpoint.dir names; only a local session may do without it."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="ledgerloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def shared_copy(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: for a table that is dear to make and read by many branches."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_parts(df: DataFrame, name: str, key: str, n: int) -> DataFrame:
    """As shared_copy, for branches that all work by `key`: the copy remembers that its rows lie in n parts by it, so that
    groups, windows and joins by it (and more columns) move no row. df: placed by `key` in n parts, else a task writes a
    file for each part that it has rows of. Only the session's catalog knows the parts; the files are in the shared folder."""
    path = scratch_dir(df.sparkSession, name)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    df.write.format("parquet").bucketBy(n, key).option("path", path).saveAsTable(table)
    return df.sparkSession.table(table)


def write_json(df: DataFrame, path: str) -> None:
    """Nested rows as JSON lines."""
    df.write.mode("overwrite").json(path)


def write_artifact(df: DataFrame, path: str, key: str) -> None:
    """(key, artifact): all other columns of a row as one JSON text, in Parquet."""
    rest = [c for c in df.columns if c != key]
    df.select(key, F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}).alias("artifact")).write.mode("overwrite").parquet(path)


def key_results(df: DataFrame, key: str, sources: dict[str, str]) -> DataFrame:
    """(key, metric, value, source): a row for each measure of a wide row; `sources` names its engine."""
    measures = [F.struct(F.lit(c).alias("metric"), F.col(c).cast("string").alias("value"), F.lit(s).alias("source")) for c, s in sources.items()]
    return df.select(key, F.inline(F.array(*measures)))


def write_markdown(results: DataFrame, path: str, key: str) -> None:
    """A Markdown table of key_results for each key, one text row a key, lines in order of the metric."""
    line = F.concat(F.lit("| "), "metric", F.lit(" | "), F.coalesce("value", F.lit("N/A")), F.lit(" | "), "source", F.lit(" |"))
    table = results.groupBy(key).agg(F.concat_ws("\n", F.lit("| Metric | Value | Source |"), F.lit("|---|---|---|"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("metric", line.alias("line")))), lambda x: x["line"]), "\n")).alias("table"))
    table.write.mode("overwrite").parquet(path)


def write_bundle(features: DataFrame, path: str, engine_col: str = "engine") -> None:
    """One partitioned write of all engines' features instead of a file for each."""
    features.write.mode("overwrite").partitionBy(engine_col).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    flatten(df).write.mode("overwrite").option("header", True).csv(path)


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", batch: int = 1000) -> None:
    """Rows with a date, in batches; needs a JDBC driver on the class path."""
    df.na.drop(subset=["date"]).write.format("jdbc").option("url", url).option("dbtable", table).option("batchsize", batch).mode(mode).save()


def read_version(spark: SparkSession, path: str) -> DataFrame:
    """The latest whole version of a versioned table."""
    return spark.read.parquet(f"{path}/v={_versions(spark, path)[-1]}")


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Versions whose write has ended, in order: a listing of a few folders by the driver."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(int(n[2:]) for n in names if n.startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS")))


def upsert(spark: SparkSession, path: str, rows: DataFrame, keys: list[str]) -> None:
    """Adds a version of the table at `path` in which rows with a key among `rows` are replaced and the others stay: an
    anti-join and a union. Versions before are never touched, so a write that fails leaves the table as it was."""
    known = _versions(spark, path)
    new = spark.read.schema(rows.schema).parquet(f"{path}/v={known[-1]}").join(rows.select(*keys).distinct(), keys, "left_anti").unionByName(rows) if known else rows
    new.write.mode("overwrite").parquet(f"{path}/v={known[-1] + 1 if known else 0}")
