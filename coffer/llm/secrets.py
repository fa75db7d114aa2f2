r"""Secret scan with corpus-wide ownership frequency (operator 9, native).

Candidates are found in every whole text by fixed patterns (``KINDS``). Each candidate's value is hashed, and the
hashes are counted over the corpus by distinct repositories (documents) and distinct owners (sources). A value that
``min_owners`` owners or more have in common is a widely copied example; one that fewer have is taken for a live
credential of its owner. ``redact`` masks live values and leaves examples. A private key is its whole block: the body is
the value, and all from the header through the footer (or the end of the body, where the footer is missing) is the span.

Offsets without a UDF: ``split`` gives the text between matches and ``regexp_extract_all`` the matches of the same
pattern, so their lengths, summed in turn, are the offsets in code points. Both run only on texts in which a cheap
test finds a pattern.

Hot values: counting first folds (value, owner, document), then (value, owner), then value, each with map-side
combining, so a value that a third of all rows hold is never gathered.

Edge cases: null text counts as empty; texts without a candidate get zero counts, empty span strings and the digest
of the empty string; null sources are one owner; repeated rows count as one repository. Only hashes of values are
written to intermediate tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import load, materialize, text_of

#: Fixed by the task: the three base patterns (kind, pattern, group that holds the value, least length of that group).
BASE = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: What stands between the pieces of a key's body (white space, also escaped, marks of quoting), and the end of a line.
_BETWEEN = r"""(?:[\s"'>#*|,]|\\+[nrt]|\+(?=\s))"""
_EOL = r"""[\x20\t\r"',+]*+(?:\n|\\+[nr]|\z)"""
_END = r"-----END [A-Z ]*PRIVATE KEY-----"
#: A private key block: header, body (the group) up to the footer. Without a footer the body is what follows of header
#: fields, long base64 runs and lines that are one base64 run. Loops are possessive, so a long body needs no stack.
PRIVATE_KEY = (
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----"
    rf"((?:[^-]*+(?:-(?!----(?:BEGIN|END) )[^-]*+)*+(?={_END}))"
    rf"|(?:{_BETWEEN}*+(?:Proc-Type|DEK-Info|Content-Domain|Comment|Version):[^\n\\]*+)*+"
    rf"(?:{_BETWEEN}*+[A-Za-z0-9+/=]{{24,}}+|[^\S\n]*+(?:\n|\\+[nr]){_BETWEEN}*+[A-Za-z0-9+/=]++(?={_EOL}))*+)"
    rf"(?:{_END})?")
#: Further credential formats: private key blocks, hosting-service tokens, chat tokens, signed web tokens, bearer headers.
MORE = (
    ("private_key", PRIVATE_KEY, 1, 0),
    ("hosting", r"\bgh[pousr]_[A-Za-z0-9]{20,}", 0, 0),
    ("chat", r"\bxox[abprs]-[A-Za-z0-9-]{10,}", 0, 0),
    ("web_token", r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*", 0, 0),
    ("bearer", r"\bBearer\x20+[A-Za-z0-9+/_.=~-]{20,}", 0, 0),
)
KINDS = BASE + MORE
#: What is no part of a value of a kind: a key is the same however its lines are broken, indented or escaped.
LAYOUT = {"private_key": r"\\+[nrt]|[^A-Za-z0-9+/=]+"}
ANY = (r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]|AKIA[A-Z0-9]|[0-9a-f]{24}"
       r"|-----BEGIN|gh[pousr]_|xox[abprs]-|eyJ|Bearer\x20")
SPAN = "array<struct<start:int,rank:int,end:int,kind:string,value:string>>"
MIN_OWNERS = 3


def _matches(text: Column, rank: int, kind: str, pattern: str, group: int, least: int) -> Column:
    """Spans of one kind, in order; ``value`` is the SHA-256 of the credential itself (for a key block, of its body)."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    found = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), whole.alias("whole"), value.alias("value"))
    bare = lambda v: F.regexp_replace(v, LAYOUT[kind], "") if kind in LAYOUT else v
    none = F.array().cast(SPAN)
    folded = F.aggregate(
        found, F.struct(F.lit(0).alias("at"), none.alias("spans")),
        lambda acc, m: F.struct(
            (acc["at"] + F.length(m["gap"]) + F.coalesce(F.length(m["whole"]), F.lit(0))).alias("at"),
            F.when(F.length(m["value"]) >= least, F.concat(acc["spans"], F.array(F.struct(
                (acc["at"] + F.length(m["gap"])).alias("start"), F.lit(rank).alias("rank"),
                (acc["at"] + F.length(m["gap"]) + F.length(m["whole"])).alias("end"), F.lit(kind).alias("kind"),
                F.sha2(bare(m["value"]), 256).alias("value"))))).otherwise(acc["spans"]).alias("spans")),
        lambda acc: acc["spans"])
    return F.when(F.size(whole) > 0, folded).otherwise(none)


def candidates(text: Column) -> Column:
    """All spans of a text, by start and then by kind as listed."""
    every = F.concat(*[_matches(text, i, *k) for i, k in enumerate(KINDS)])
    return F.when(text.rlike(ANY), F.sort_array(every)).otherwise(F.array().cast(SPAN))


def ownership(found: DataFrame, min_owners: int = MIN_OWNERS) -> DataFrame:
    """``value, repositories, owners, example`` of every candidate value in ``found`` (``doc_id, source, spans``)."""
    each = found.select("doc_id", "source", F.explode("spans").alias("s")).select("doc_id", "source", "s.value")
    by_owner = each.groupBy("value", "source", "doc_id").agg(F.lit(1).alias("one")).groupBy("value", "source").agg(F.sum("one").alias("n"))
    return (by_owner.groupBy("value").agg(F.sum("n").alias("repositories"), F.count(F.lit(1)).alias("owners"))
            .withColumn("example", F.col("owners") >= min_owners))


def scan(docs: DataFrame, min_owners: int = MIN_OWNERS) -> tuple[DataFrame, DataFrame]:
    """(found, judged): spans of every row of ``docs``, and for each (doc_id, spans) that has any, its spans with
    ``example``, ``owners`` and ``repositories``."""
    found = materialize(docs.select("doc_id", "source", candidates(text_of()).alias("spans")), "secret-spans")
    values = ownership(found, min_owners)
    some = found.filter(F.size("spans") > 0).select("doc_id", "spans").distinct().withColumn("at", F.sha2(F.to_json("spans"), 256))
    each = some.select("doc_id", "at", F.explode("spans").alias("s"))
    e, v = each.alias("e"), values.alias("v")
    judged = (e.join(v, F.col("e.s.value") == F.col("v.value"))
              .select("doc_id", "at", F.struct("s.start", "s.rank", "s.end", "s.kind", "v.example", "v.owners", "v.repositories").alias("j"))
              .groupBy("doc_id", "at").agg(F.sort_array(F.collect_list("j")).alias("judged")))
    return found, judged


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, min_owners: int = MIN_OWNERS) -> DataFrame:
    """Counts, digest, spans and verdicts of every row of ``docs``."""
    found, judged = scan(docs, min_owners)
    f = found.withColumn("at", F.when(F.size("spans") > 0, F.sha2(F.to_json("spans"), 256))).alias("f")
    both = f.join(judged.alias("j"), F.expr("f.doc_id <=> j.doc_id AND f.at = j.at"), "left")
    count = lambda kind: F.size(F.filter("f.spans", lambda s: s["kind"] == kind)).cast("long")
    verdicts = lambda example: F.coalesce(F.size(F.filter("j.judged", lambda s: s["example"] == F.lit(example))), F.lit(0)).cast("long")
    base = _joined(F.filter("f.spans", lambda s: s["rank"] < len(BASE)))
    return both.select(
        "f.doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(base, 256).alias("base_sha256"), _joined(F.col("f.spans")).alias("spans"),
        verdicts(False).alias("n_live"), verdicts(True).alias("n_example"))


def redact(docs: DataFrame, min_owners: int = MIN_OWNERS, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every owner-specific candidate replaced by ``mask``; overlapping spans are masked once and
    ``n_chars`` follows the new text. Only texts with a candidate are shuffled."""
    _, judged = scan(docs, min_owners)
    live = materialize(judged.select(F.col("doc_id").alias("of"), "at", F.filter("judged", lambda s: ~s["example"]).alias("live"))
                       .filter(F.size("live") > 0), "secret-live")
    # user columns travel in one struct, so their names can't clash
    rows = docs.select("doc_id", "text", F.struct(*docs.columns).alias("row"))
    hit = text_of().rlike(ANY)
    with_spans = rows.filter(hit).withColumn("found_at", F.sha2(F.to_json(candidates(text_of())), 256))
    joined = with_spans.join(live, F.expr("doc_id <=> of AND found_at = at"), "left")
    done = F.aggregate(
        F.col("live"), F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.when(s["end"] <= acc["at"], acc).otherwise(F.struct(
            s["end"].alias("at"),
            F.when(s["start"] < acc["at"], acc["out"]).otherwise(F.concat(
                acc["out"], F.col("text").substr(acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask))).alias("out"))),
        lambda acc: F.concat(acc["out"], F.col("text").substr(acc["at"] + 1, F.length("text"))))
    masked = joined.select(F.when(F.col("live").isNotNull(), done).otherwise(F.col("text")).alias("masked"), F.col("live").isNotNull().alias("cut"), "row")
    new = {"text": F.col("masked"), "n_chars": F.when(F.col("cut"), F.length("masked").cast("long")).otherwise(F.col("row").getField("n_chars")) if "n_chars" in docs.columns else None}
    clean = masked.select(*[(new[c] if c in new else F.col("row").getField(c)).alias(c) for c in docs.columns])
    return docs.filter(~hit).unionByName(clean)


def op9_secret_scan(spark, sf_dir) -> DataFrame:
    """Secrets of every document: counts, digest of the base spans, all spans, live and example candidates."""
    return report(load(spark, sf_dir, "documents").select("doc_id", "text", "source"))
