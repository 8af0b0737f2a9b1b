"""Secret scans over content-addressed texts, with a ledger of what has been scanned.

A text is stored under its SHA-256 (a blob); a path is the row that held it at some time. A scan takes only the
pairs of blob and rule version that the ledger does not have, so a copied or unchanged text is scanned once, and a new
rule version scans every blob for that rule alone. Findings belong to blobs and are joined back to all paths.
Everything is built from SQL functions: positions of all matches come from the pieces between them.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carepath.session import materialise


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern`` whose group ``group`` has ``least`` characters or more.

    ``rank`` orders findings that start at one place. ``first`` is a cheap test that each match implies.
    A changed pattern needs a new version.
    """

    kind: str
    pattern: str
    least: int
    rank: int
    group: int = 0
    version: int = 1
    first: str | None = None


#: The base rules.
BASE_RULES = (
    Rule(
        "assign",
        r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        6,
        0,
        2,
        first=r"(?i:passw(?:or)?d|secret|token|api_?key)",
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 20, 1, first=r"AKIA[A-Z0-9]{16}"),
    # a run of fewer characters never matches, so the least length stands in the pattern
    Rule("hex", r"[0-9a-f]{24,}", 24, 2, first=r"[0-9a-f]{24}"),
)
#: rules beside the base ones: headers of private keys, signed web tokens
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 1, 3, first=r"-----BEGIN "),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40, 4, first=r"eyJ[A-Za-z0-9_-]+\.eyJ"),
)
RULES = BASE_RULES + MORE_RULES
LEDGER = "blob string, kind string, version int"
FINDINGS = f"{LEDGER}, start long, end long"


def address(text: Column) -> Column:
    """The SHA-256 of a text in UTF-8; a null text counts as an empty one."""
    return F.sha2(F.encode(F.coalesce(text, F.lit("")), "UTF-8"), 256)


def spans(blobs: DataFrame, rule: Rule) -> DataFrame:
    """Findings of one rule in ``blobs`` (``blob, text``): ``blob, kind, version, start, end``, code points, end exclusive.

    Matches are leftmost and do not overlap; those with too short a group are dropped after that. The start of a match
    is the length of all pieces and matches before it, summed in a window of one row per match.
    """
    text, pattern = F.col("text"), F.lit(rule.pattern)
    candidates = blobs.filter(text.rlike(rule.first)) if rule.first else blobs
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    groups = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else hits
    matches = candidates.select(
        "blob",
        F.transform(F.split(text, rule.pattern, -1), F.length).alias("gap"),
        F.transform(hits, F.length).alias("hit"),
        F.transform(groups, F.length).alias("part"),
    ).select("blob", F.posexplode(F.arrays_zip(F.slice("gap", F.lit(1), F.size("hit")).alias("gap"), "hit", "part")).alias("place", "match"))
    before = Window.partitionBy("blob").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("match.gap") + F.col("match.hit")).over(before)
    return (
        matches.withColumn("end", end)
        .filter(F.col("match.part") >= rule.least)
        .select(
            "blob",
            F.lit(rule.kind).alias("kind"),
            F.lit(rule.version).alias("version"),
            (F.col("end") - F.col("match.hit")).alias("start"),
            "end",
        )
    )


def rule_name(kind: Column, version: Column) -> Column:
    return F.concat_ws(":", kind, version.cast("string"))


def unseen(paths: DataFrame, ledger: DataFrame | None) -> DataFrame:
    """``blob, text, seen``: each blob once, with the rules (``kind:version``) that it has been scanned for.

    The rows of a blob meet in an aggregate with a partial one before the shuffle, so a text with very many copies is
    sent once a task.
    """
    blobs = paths.groupBy("blob").agg(F.first("text").alias("text"))
    if ledger is None:
        return blobs.withColumn("seen", F.array().cast("array<string>"))
    known = ledger.groupBy("blob").agg(F.collect_set(rule_name(F.col("kind"), F.col("version"))).alias("seen"))
    return blobs.join(known, "blob", "left").withColumn("seen", F.coalesce("seen", F.array().cast("array<string>")))


def scan(paths: DataFrame, rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """New findings and new ledger rows for ``paths`` (``blob, text``); both are written tables.

    Texts whose blob the ledger has for every rule are not looked at again, nor is a rule run again on a blob that
    has been scanned for that version of it.
    """
    blobs = unseen(paths, ledger)
    names = [f"{r.kind}:{r.version}" for r in rules]
    wanted = F.array_except(F.array(*map(F.lit, names)), F.col("seen"))
    todo = blobs.withColumn("todo", wanted).filter(F.size("todo") > 0)
    by_rule = [spans(todo.filter(F.array_contains("todo", n)), r) for n, r in zip(names, rules)]
    findings = materialise(reduce(DataFrame.unionByName, by_rule), "findings")
    scanned = (
        unseen(paths.select("blob", F.lit("").alias("text")), ledger)
        .select("blob", F.explode(wanted).alias("rule"))
        .select("blob", F.split_part("rule", F.lit(":"), F.lit(1)).alias("kind"), F.split_part("rule", F.lit(":"), F.lit(2)).cast("int").alias("version"))
    )
    return findings, scanned


class Ledger:
    """The ledger and the findings of a folder, as two growing tables.

    Findings are written before the ledger rows that say they are complete: after a crash in between, pairs are
    scanned again and their findings are there twice, which :meth:`findings` takes back.
    """

    def __init__(self, spark, folder: str):
        self.spark, self.folder = spark, folder

    def _table(self, name: str, schema: str) -> DataFrame | None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}") if there else None

    def scanned(self) -> DataFrame | None:
        return self._table("ledger", LEDGER)

    def findings(self, rules: tuple[Rule, ...]) -> DataFrame:
        """Findings of these rules in their present versions."""
        table = self._table("findings", FINDINGS)
        if table is None:
            return self.spark.createDataFrame([], FINDINGS)
        now = [f"{r.kind}:{r.version}" for r in rules]
        return table.filter(rule_name(F.col("kind"), F.col("version")).isin(now)).distinct()

    def add(self, docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> None:
        """Scan what is new in ``docs``, a further version or batch of documents."""
        paths = docs.select(address(F.col(text)).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        findings, scanned = scan(paths, rules, self.scanned())
        findings.write.mode("append").parquet(f"{self.folder}/findings")
        scanned.write.mode("append").parquet(f"{self.folder}/ledger")


def report(docs: DataFrame, ledger: Ledger, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE_RULES) -> DataFrame:
    """One row per path: ``doc_id``, a count for each base rule, the hash of the base spans, all spans, and the blob.

    Null and empty texts have no spans. Repeated rows and copies get the findings of their blob; the join on the
    blob has one row per blob on one side. An empty table gives an empty table. Other columns are not read.
    """
    ranks = reduce(lambda rest, r: F.when(F.col("kind") == r.kind, r.rank).otherwise(rest), rules, F.lit(len(rules)))
    entries = F.sort_array(F.collect_list(F.struct("start", ranks.alias("rank"), "end", "kind")))
    of_kind = lambda k: F.filter("base", lambda x: x["kind"] == k)
    show = lambda array: F.concat_ws(",", F.transform(array, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])))
    kinds = [r.kind for r in base]
    per_blob = ledger.findings(rules).groupBy("blob").agg(entries.alias("all"))
    per_blob = per_blob.withColumn("base", F.filter("all", lambda x: x["kind"].isin(kinds))).select(
        "blob",
        *[F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in kinds],
        F.sha2(show(F.col("base")), 256).alias("base_sha256"),
        show(F.col("all")).alias("spans"),
    )
    paths = docs.select(F.col(key).alias("doc_id"), address(F.col(text)).alias("blob"))
    return paths.join(per_blob, "blob", "left").select(
        "doc_id",
        *[F.coalesce(f"n_{k}", F.lit(0).cast("long")).alias(f"n_{k}") for k in kinds],
        F.coalesce("base_sha256", F.sha2(F.lit(""), 256)).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
        "blob",
    )
