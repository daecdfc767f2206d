"""Secret scans by an incremental blob ledger, with DataFrame functions only.

A text is content-addressed by its SHA-256, so all rows and versions that hold the same text are one blob. The ledger is
a folder of Parquet batches that says, for each blob, which rules in which versions have been run on it and what they
found. ``scan`` compares digests with the ledger, runs only the pairs of blob and rule version that it lacks, appends
them as a new batch, and joins the findings back to every row of the input. So where the ledger knows all but a few of
the blobs the texts of the others are not shuffled. A batch that was appended twice, or by two scans at once, says the same twice and counts
once.

Positions are code points from 0, end exclusive. Spark has no function for the positions of all matches, so they are
summed from the lengths of the pieces between matches and of the matches themselves, in order.

Null texts count as empty; texts of any length are read whole. Each row of the input, repeated or not, with an id or
without, comes out once with its findings, which may be none; an empty table gives no rows. Of the other columns those
asked for are kept; the names of the two new ones can be chosen where they clash.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import drop, release, shared_dir, small, stored, table


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern``, leftmost and not overlapping, whose ``group`` has ``least`` characters or more."""

    kind: str
    version: int
    pattern: str
    group: int
    least: int
    #: A pattern that finds something in every text with a finding; most texts are passed over by it.
    hint: str

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


#: The rules, in the order of their kinds. A repeated group would recurse in Java for each repeat and run out
#: of stack on long texts, so what repeats is a class of characters.
RULES = (
    Rule("assign", 1, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, r"""(?i:passw(?:or)?d|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{12}"""),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 18, r"AKIA[A-Z0-9]{14}"),
    Rule("hex", 1, r"[0-9a-f]+", 0, 16, r"[0-9a-f]{16}"),
    Rule("private_key", 2, r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----", 0, 1, r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----"),
)
BASE = ("assign", "access", "hex")
#: A private key is found by its marker. Its block goes on to the end marker or, where that is missing, over the lines of
#: base64, whole or with escaped line breaks, that come after it and its headers: up to the first other sign, or a word
#: that is short and not a line of its own.
KEY_START = r"\A-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----"
KEY_END = r"-----END [A-Z0-9 ]*PRIVATE KEY-----"
KEY_HEAD = r"\A\s*(?:(?:Proc-Type|DEK-Info):[^\n]*\s+){0,2}"
KEY_STOP = r"(?m)[^\sA-Za-z0-9+/=\\]|(?<!\S)(?![A-Za-z0-9+/\\]{24}|(?<=\n[ \t]{0,8})[A-Za-z0-9+/]+={0,2}[ \t\r]*$)\S"
#: Findings that are taken together where places are summed.
STRETCH = 128
SPANS = "array<struct<start:int,kind_no:int,end:int,kind:string>>"
LEDGER = "blob_id binary, rules array<string>, found array<struct<start:int,rule:string,end:int>>"


def _bound(value: Column, f) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` uses it."""
    return F.transform(F.array(value), f)[0]


def _placed(parts: Column, gap, size, ok, rule: str) -> Column:
    """Of parts one after another, each a gap and then a finding, the places of those that are ``ok``.

    Places are summed within stretches, then those of the stretches: a list that grows by one is copied each time."""
    kind = "array<struct<start:int,rule:string,end:int>>"

    def grown(acc: Column, x: Column) -> Column:
        start = acc["at"] + gap(x)
        end = start + size(x)
        found = F.array(F.struct(start.alias("start"), F.lit(rule).alias("rule"), end.alias("end"))).cast(kind)
        return F.struct(end.alias("at"), F.when(ok(x), F.concat(acc["found"], found)).otherwise(acc["found"]).alias("found"))

    def summed(p: Column) -> Column:
        none = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("found"))
        last = F.floor((F.size(p) - 1) / STRETCH).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.aggregate(F.slice(p, i * STRETCH + 1, F.lit(STRETCH)), none, grown))

    def moved(stretches: Column) -> Column:
        ends = F.aggregate(stretches, F.array(F.lit(0)), lambda acc, s: F.concat(acc, F.array(F.element_at(acc, -1) + s["at"])))
        shift = lambda x, by: F.struct((x["start"] + by).alias("start"), x["rule"].alias("rule"), (x["end"] + by).alias("end"))
        return _bound(ends, lambda e: F.flatten(F.transform(stretches, lambda s, i: F.transform(s["found"], lambda x: shift(x, e[i])))))

    return _bound(_bound(parts, summed), moved)


def spans(text: Column, rule: Rule) -> Column:
    """The findings of one rule in ``text``."""
    parts = F.arrays_zip(
        F.split(text, rule.pattern, -1).alias("between"),
        F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)).alias("match"),
        F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)).alias("value"),
    )
    size = lambda x: F.coalesce(F.length(x["match"]), F.lit(0))
    walked = _placed(parts, lambda x: F.length(x["between"]), size, lambda x: F.length(x["value"]) >= rule.least, rule.name)
    return F.when(text.rlike(rule.hint), walked).otherwise(F.array().cast("array<struct<start:int,rule:string,end:int>>"))


def _ledger(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def scan(df: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, keep: tuple[str, ...] = ("doc_id",), text: str = "text", blob: str = "blob_id", out: str = "found") -> DataFrame:
    """The columns ``keep`` of each row with ``blob``, the digest of its text, and ``out``, all findings in order; adds to
    the ledger what it lacks. A kept column of one of these two names gives way."""
    spark = df.sparkSession
    keep = [c for c in keep if c not in (blob, out)]
    body = F.coalesce(F.col(text), F.lit(""))
    digest = F.unhex(F.sha2(body, 256)).alias("blob_id")
    blobs = df.select(digest, body.alias("text"))
    wanted = F.array(*(F.lit(r.name) for r in rules))
    known = _ledger(spark, ledger)
    unseen = None
    if known is None:
        todo = blobs.groupBy("blob_id").agg(F.first("text").alias("text")).withColumn("rules", wanted)
    else:
        done = known.select("blob_id", F.explode("rules").alias("rule")).where(F.col("rule").isin([r.name for r in rules])).groupBy("blob_id").agg(F.collect_set("rule").alias("done"))
        left = F.array_except(wanted, F.coalesce("done", F.array().cast("array<string>")))
        unseen = stored(df.select(digest).distinct().join(done, "blob_id", "left").select("blob_id", left.alias("rules")).where(F.size("rules") > 0), "unseen")
        few = small(unseen, F.lit(128))
        if few is unseen:  # copies fall together before they are shuffled, so a hot blob is no hot key
            todo = blobs.groupBy("blob_id").agg(F.first("text").alias("text")).join(unseen, "blob_id")
        else:
            todo = blobs.join(few, "blob_id").groupBy("blob_id").agg(F.first("text").alias("text"), F.first("rules").alias("rules"))
    found = [F.when(F.array_contains("rules", r.name), spans(F.col("text"), r)) for r in rules]
    found = F.flatten(F.filter(F.array(*found), lambda f: f.isNotNull()))
    todo.select("blob_id", "rules", found.alias("found")).write.mode("append").option("compression", "zstd").parquet(ledger)
    if unseen is not None:
        drop(unseen)

    # Only findings of the rules at hand: earlier batches may have run other versions.
    ours = F.filter("found", lambda f: F.array_contains(wanted, f["rule"]))
    told = F.transform(F.flatten(F.collect_list("found")), lambda f: F.struct(f["start"].alias("start"), (F.array_position(wanted, f["rule"]) - 1).cast("int").alias("kind_no"), f["end"].alias("end"), F.substring_index(f["rule"], "@", 1).alias("kind")))
    findings = _ledger(spark, ledger).select(F.col("blob_id").alias(blob), ours.alias("found")).where(F.size("found") > 0).groupBy(blob).agg(F.sort_array(told).alias(out)).withColumn(out, _bound(F.col(out), lambda s: F.filter(s, lambda f, i: (i == 0) | (f != s[F.greatest(i - 1, F.lit(0))]))))
    findings = stored(findings, "findings")
    findings = small(findings, F.size(out) * 32 + 64)
    rows = df.select(*(F.col(c) for c in keep), digest.alias(blob))
    return rows.join(findings, blob, "left").select(*keep, blob, F.coalesce(F.col(out), F.array().cast(SPANS)).alias(out))


def joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")


def key_length(piece: Column) -> Column:
    """How many characters a private key takes of a piece of text that starts with its marker."""
    marker = F.length(F.regexp_extract(piece, KEY_START, 0))
    body = F.substr(piece, marker + 1)
    closed = F.split(body, KEY_END, 2)
    head = F.regexp_extract(body, KEY_HEAD, 0)
    lines = F.rtrim(F.concat(head, F.split(F.substr(body, F.length(head) + 1), KEY_STOP, 2)[0]), F.lit(" \t\r\n"))
    return marker + F.when(F.size(closed) > 1, F.length(closed[0]) + F.length(F.regexp_extract(body, KEY_END, 0))).otherwise(F.length(lines))


def key_blocks(text: Column) -> Column:
    """Where the private keys of a text start and end, with what follows their markers."""
    pieces = F.transform(F.split(text, "(?=-----BEGIN )", -1), lambda p: F.struct(F.length(p).alias("all"), F.when(p.rlike(KEY_START), key_length(p)).alias("key")))
    # A piece without a key is a gap; what follows a key in its piece is the next one's gap.
    parts = F.flatten(F.transform(pieces, lambda p: F.array(F.struct(F.lit(0).alias("gap"), F.coalesce(p["key"], F.lit(0)).alias("size")), F.struct((p["all"] - F.coalesce(p["key"], F.lit(0))).alias("gap"), F.lit(0).alias("size")))))
    return _placed(parts, lambda x: x["gap"], lambda x: x["size"], lambda x: x["size"] > 0, "key")


def redacted(text: Column, found: Column, mark: str = "[secret]") -> Column:
    """``text`` with each stretch that findings cover, overlapping ones together, replaced by ``mark``. Of a private key
    the whole block is replaced. Takes time by the length of the text: each lot of findings is cut out of its own part."""
    plain = lambda found: F.transform(found, lambda f: F.struct(f["start"].alias("start"), f["end"].alias("end")))
    keys = F.when(F.exists(found, lambda f: f["kind"] == "private_key"), key_blocks(text)).otherwise(F.array().cast("array<struct<start:int,rule:string,end:int>>"))
    covered = F.sort_array(F.concat(plain(found), plain(keys)))

    def lots(all_: Column) -> Column:
        last = F.floor((F.size(all_) - 1) / STRETCH).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(all_, i * STRETCH + 1, F.lit(STRETCH)))

    def cut(lot: Column, low: Column) -> Column:
        """The pieces of text before the findings of a lot, each with a mark after it; all before ``low`` is done."""

        def grown(part: Column):
            def step(acc: Column, f: Column) -> Column:
                piece = F.concat(F.substr(part, acc["at"] - low + 1, F.greatest(f["start"] - acc["at"], F.lit(0))), F.lit(mark))
                pieces = F.when(f["start"] >= acc["at"], F.concat(acc["out"], F.array(piece))).otherwise(acc["out"])
                return F.struct(F.greatest(acc["at"], f["end"]).alias("at"), pieces.alias("out"))

            return step

        none = F.struct(low.alias("at"), F.array().cast("array<string>").alias("out"))
        part = F.substr(text, low + 1, F.greatest(F.element_at(lot, -1)["start"] - low, F.lit(0)))
        return _bound(part, lambda p: F.aggregate(lot, none, grown(p))["out"])

    def joined_(lots_: Column) -> Column:
        high = lambda lot: F.array_max(F.transform(lot, lambda f: f["end"]))
        ends = F.aggregate(lots_, F.array(F.lit(0)), lambda acc, lot: F.concat(acc, F.array(F.greatest(F.element_at(acc, -1), high(lot)))))
        pieces = lambda e: F.flatten(F.transform(lots_, lambda lot, i: cut(lot, e[i])))
        return _bound(ends, lambda e: F.array_join(F.concat(pieces(e), F.array(F.substr(text, F.element_at(e, -1) + 1))), ""))

    return F.when(F.size(found) > 0, _bound(_bound(covered, lots), joined_)).otherwise(text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scans against one ledger, as of a corpus that has grown: of some rows, then of all rows, of whose texts only
    those that the ledger lacks are read for secrets."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ledger = f"{shared_dir(spark)}/secret-ledger-{uuid.uuid4().hex}"
    scan(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0), ledger)
    release(spark)
    out = scan(docs, ledger)
    count = lambda kind: F.size(F.filter("found", lambda f: f["kind"] == kind)).cast("long")
    base = F.filter("found", lambda f: f["kind"].isin(*BASE))
    return out.select("doc_id", *(count(k).alias(f"n_{k}") for k in BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))
