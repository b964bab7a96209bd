"""Secret scans by an incremental ledger of blobs (DataFrame functions only).

Every version of a file is addressed by the SHA-256 of its text. The ledger holds one row for each blob
and rule version that has been scanned. A run scans only the pairs that the ledger lacks, one copy a blob,
and joins the findings back to every path that holds the blob.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A kind of secret: leftmost non-overlapping matches whose ``group`` has at least ``least`` characters.

    ``sign`` is a short pattern that every text with a match holds; without one it is the pattern.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1
    sign: str = ""

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: The base kinds, in the order in which ties of start are listed, then the kinds the ledger adds.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, sign="(?i:passw|secret|token|api_?key)"),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, sign="AKIA"),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
)
#: A private key: its header, then all up to its END line, or the base64 that follows where that line is missing. Only
#: single character classes repeat without a bound, so long texts need no deep stack.
_PEM = (
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----"
    r"(?:[^-]*(?:-{1,4}[^-]+){0,20}-----END [A-Z ]*PRIVATE KEY-----"
    r"|[ \t\r\n\\]{0,8}(?:[A-Za-z]+-[A-Za-z]+:[^\n]*\n){0,4}[ \t\r\n\\]{0,8}[A-Za-z0-9+/=]{16}[A-Za-z0-9+/=\r\n\\]*)?"
)
ADDED_RULES = (
    Rule("pem", _PEM, version=2, sign="-----BEGIN "),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", sign="eyJ"),
    Rule("bearer", r"gh[pousr]_[A-Za-z0-9]{36,}", sign="gh[pousr]_"),
)
RULES = BASE_RULES + ADDED_RULES

_SPANS = "array<struct<start:int,rank:int,kind:string,end:int>>"


def content_address(text: str | Column) -> Column:
    """Address of a version; a null text is the empty blob."""
    return F.sha2(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), 256)


def rule_spans(text: Column, rule: Rule, rank: int) -> Column:
    """Spans (code points, end exclusive) of one rule. The pieces between matches give the offsets."""
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    pieces = F.split(text, rule.pattern, -1)
    steps = F.zip_with(
        F.zip_with(pieces, matches, lambda p, m: F.struct(F.length(p).alias("gap"), F.length(m).alias("size"))),
        values,
        lambda s, v: F.struct(s["gap"].alias("gap"), s["size"].alias("size"), F.length(v).alias("value")),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("spans"))
    begin = lambda s, x: s["at"] + x["gap"]
    end = lambda s, x: begin(s, x) + F.coalesce(x["size"], F.lit(0))
    found = lambda s, x: F.struct(
        begin(s, x).alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), end(s, x).alias("end")
    )
    walk = F.aggregate(
        steps,
        start,
        lambda s, x: F.struct(
            end(s, x).alias("at"),
            F.when(x["value"] >= rule.least, F.concat(s["spans"], F.array(found(s, x)))).otherwise(s["spans"]).alias("spans"),
        ),
    )["spans"]
    return F.when(text.rlike(rule.pattern), walk).otherwise(F.array().cast(_SPANS))


def signed(text: Column, rules: tuple[Rule, ...]) -> Column:
    """Whether a text may hold a match of any rule; false for null."""
    return F.coalesce(text.rlike("|".join(f"(?:{r.sign or r.pattern})" for r in rules)), F.lit(False))


def scan_unseen(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New ledger rows (blob, rule, spans) for the pairs of blob and rule version that ``ledger`` lacks.

    ``versions`` has text. Copies of a blob are dropped on the map side before texts move, so a blob with very
    many copies costs one row a task; a text without a sign of any rule has no match, so it stays where it is and only
    its address moves. A null text is the empty blob, which is scanned too.
    """
    texts = versions.select(content_address("text").alias("blob"), F.when(signed(F.col("text"), rules), F.col("text")).alias("text"))
    if ledger is not None:
        done = ledger.where(F.col("rule").isin([r.key for r in rules])).groupBy("blob").agg(F.collect_set("rule").alias("done"))
        # Only blobs with some rule left to run move on; those the ledger has in full are left out here.
        texts = texts.join(done, "blob", "left").where(F.coalesce(F.size("done"), F.lit(0)) < len(rules))
    else:
        texts = texts.withColumn("done", F.lit(None).cast("array<string>"))
    blobs = texts.groupBy("blob").agg(F.first("text").alias("text"), F.first("done").alias("done"))
    blobs = blobs.withColumn("text", F.coalesce("text", F.lit("")))
    scans = F.array(
        *[
            F.when(
                ~F.coalesce(F.array_contains("done", r.key), F.lit(False)),
                F.struct(F.lit(r.key).alias("rule"), rule_spans(F.col("text"), r, i).alias("spans")),
            )
            for i, r in enumerate(rules)
        ]
    )
    return blobs.select("blob", F.explode(scans).alias("scan")).where("scan is not null").select("blob", "scan.rule", "scan.spans")


def update_ledger(versions: DataFrame, folder: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan what the ledger in ``folder`` lacks, append it there, and return the whole ledger.

    The folder is created where it is missing. Two runs at once may both append a pair; readers take it once.
    """
    spark = versions.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    there = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path)
    schema = f"blob string, rule string, spans {_SPANS}"
    seen = spark.read.schema(schema).parquet(folder) if there else None
    scan_unseen(versions, seen, rules).write.mode("append").parquet(folder)
    return spark.read.schema(schema).parquet(folder)


def _hits(ledger: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, spans) of the blobs with findings; a pair that the ledger repeats counts once."""
    held = ledger.where(F.col("rule").isin([r.key for r in rules]) & (F.size("spans") > 0))
    return held.groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("spans")))).alias("spans"))


def findings(versions: DataFrame, ledger: DataFrame, path: str = "doc_id", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Spans of every path, from the ledger: (path, blob, spans), ordered by start, then kind as listed."""
    held = versions.select(path, content_address("text").alias("blob"))
    found = held.join(_hits(ledger, rules), "blob", "left")
    return found.select(path, "blob", F.coalesce("spans", F.array().cast(_SPANS)).alias("spans"))


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column) -> Column:
    """The text with each span replaced by [SECRET]; overlapping spans merge into one."""
    state = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda s, x: F.struct(
        F.greatest(s["at"], x["end"]).alias("at"),
        F.when(
            x["start"] >= s["at"],
            F.concat(s["out"], text.substr(s["at"] + 1, x["start"] - s["at"]), F.lit("[SECRET]")),
        )
        .otherwise(s["out"])
        .alias("out"),
    )
    walked = F.aggregate(spans, state, step)
    return F.when(F.size(spans) == 0, text).otherwise(
        F.concat(walked["out"], text.substr(walked["at"] + 1, F.length(text)))
    )


def redacted_size(text: Column, spans: Column) -> Column:
    """Code points of the redacted text, from the spans alone.

    Taking the length of ``redact`` beside its text in one projection gave a wrong count in Spark 4.1.
    """
    state = F.struct(F.lit(0).alias("at"), F.lit(0).alias("more"))
    step = lambda s, x: F.struct(
        F.greatest(s["at"], x["end"]).alias("at"),
        (
            s["more"]
            + F.when(x["start"] >= s["at"], F.length(F.lit("[SECRET]")) - x["end"] + x["start"]).otherwise(
                -F.greatest(x["end"] - s["at"], F.lit(0))
            )
        ).alias("more"),
    )
    return F.length(text) + F.aggregate(spans, state, step)["more"]


def redact_versions(docs: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Documents with every found span masked in their text, and n_chars, where there is one, of the new text.

    Only texts with a sign of some rule are joined; the others have no findings and stay as they are. All columns stay,
    whatever their names. A null text stays null; repeated rows are masked alike; an empty table gives none.
    """
    whole = F.struct(*[F.col(c) for c in docs.columns]).alias("row")
    marked = docs.select(whole, signed(F.col("text"), rules).alias("signed"))
    risky = marked.where("signed").select("row", content_address(F.col("row")["text"]).alias("blob"))
    joined = risky.join(_hits(ledger, rules), "blob", "left")
    text, clean = F.col("row")["text"], F.col("spans").isNull()
    new = {"text": F.when(clean, text).otherwise(redact(text, F.col("spans")))}
    if "n_chars" in docs.columns:
        kept = F.col("row")["n_chars"]
        new["n_chars"] = F.when(clean, kept).otherwise(redacted_size(text, F.col("spans")).cast(docs.schema["n_chars"].dataType))
    masked = joined.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
    return docs.where(~signed(F.col("text"), rules)).unionByName(masked)
