"""Secrets in documents, and how widely each candidate is copied over repositories and owners.

DataFrame functions only. The scan is one pass that keeps spans and hashes and no text; the hashes are
counted by repository and owner over the whole corpus, and the counts tell an example that many owners
copied from a credential that one owner holds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediafuse.llm.spans import occurrences
from mediafuse.llm.columns import col
from mediafuse.operators.scratch import Scratch

#: kind: (parts of which the text holds one at least, expression, group of the secret, least length of the group). Fixed values.
BASE_KINDS = {
    "assign": (("password", "passwd", "secret", "token", "apikey", "api_key"),
               r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (("akia",), r"AKIA[A-Z0-9]+", 0, 20),
    "hex": ((), r"[0-9a-f]{24,}", 0, 24),
}
MORE_KINDS = {
    "pem": (("private key",), r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", 0, 1),
    "jwt": (("eyj",), r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
    "forge": (("gh",), r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
    "chat": (("xox",), r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1),
    "cloud": (("aiza",), r"AIza[A-Za-z0-9_-]{35}", 0, 1),
    "payment": (("_live_",), r"[sr]k_live_[A-Za-z0-9]{16,}", 0, 1),
}
#: A candidate held by so many owners is taken for a copied example.
SHARED_OWNERS = 3
#: A live-looking secret has so many different characters at least, letters and digits, and none of these words. Fixed values.
LIVE_CHARACTERS, PLACEHOLDERS = 8, "example|sample|dummy|fake|test|demo|placeholder|changeme|change_me|your|foobar|qwerty|secret|passw|xxx|abcdef|012345|123456|000000"
#: Rows of counts that are sent to all tasks at most; more are joined by hash.
BROADCAST_ROWS = 100_000
_SPANS = "array<struct<start:int,rank:int,end:int,kind:string,hash:string,live:boolean>>"


def live_looking(secret: Column) -> Column:
    """Whether a secret looks like one in use rather than a word, a counter or a placeholder; a key block always does."""
    varied = F.size(F.array_distinct(F.split(secret, ""))) >= LIVE_CHARACTERS
    return secret.startswith("-----BEGIN") | (varied & secret.rlike("[0-9]") & secret.rlike("[A-Za-z]") & ~secret.rlike(f"(?i){PLACEHOLDERS}"))


def _spans(kind: str, rank: int, text: Column, low: Column) -> Column:
    parts, pattern, group, least = (BASE_KINDS | MORE_KINDS)[kind]
    gate = reduce(lambda a, b: a | b, (F.contains(low, F.lit(p)) for p in parts)) if parts else F.rlike(text, F.lit(pattern))
    found = F.filter(occurrences(text, pattern, F.length, group), lambda o: F.length(o.value) >= least)
    spans = F.transform(found, lambda o: F.struct(
        o.start.alias("start"), F.lit(rank).alias("rank"), o.end.alias("end"), F.lit(kind).alias("kind"), F.sha2(o.value, 256).alias("hash"),
        live_looking(o.value).alias("live")))
    return F.when(gate, spans.cast(_SPANS)).otherwise(F.array().cast(_SPANS))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


def scan_secrets(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str | None = None) -> DataFrame:
    """Per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans, verdicts, n_shared, n_owned, n_live.

    Spans are kind:start:end in code points, by start and then kind; verdicts gives each with what the corpus
    says of it: ``example`` (SHARED_OWNERS owners or more hold the secret), ``live`` (one owner only, in however
    many repositories, and live-looking), ``weak`` (one owner, not live-looking) or ``unclear``. n_shared, n_owned
    and n_live count the document's distinct secrets of SHARED_OWNERS owners or more, of one owner, and live.
    ``repo_col`` names the repository (default: each row is its own). Null text counts as empty; a null owner is
    one owner of its own kind; rows of equal or null id are told apart by their text, repeated rows give equal
    rows. Whole texts are scanned, in time that grows with their length and matches.
    """
    text, low = F.col("_t"), F.col("_low")
    kinds = [*BASE_KINDS, *MORE_KINDS]
    base = docs.select(col(id_col).cast("long").alias("doc_id"), F.coalesce(col(owner_col).cast("string"), F.lit("\0null")).alias("owner"),
                       (col(repo_col).cast("string") if repo_col else F.lit(None).cast("string")).alias("repo"),
                       F.coalesce(col(text_col).cast("string"), F.lit("")).alias("_t"))
    found = base.select("doc_id", "owner", "repo", F.xxhash64("doc_id", "_t").alias("k"), "_t", F.lower("_t").alias("_low")).select(
        "doc_id", "owner", "repo", "k", F.array_sort(F.concat(*(_spans(kind, i, text, low) for i, kind in enumerate(kinds)))).alias("s"))
    found = scratch.write(found, "found")

    each = scratch.write(found.where(F.size("s") > 0).select("doc_id", "owner", F.coalesce("repo", F.concat_ws(":", "doc_id", "k")).alias("repo"), "k", F.explode("s").alias("x")).select(
        "doc_id", "owner", "repo", "k", "x.*").distinct(), "each")
    counts = scratch.write(each.groupBy("hash", "owner", "repo").agg(F.lit(1).alias("one")).groupBy("hash", "owner").agg(F.count("*").alias("repos"))
                           .groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos")), "counts")
    verdict = F.when(F.col("owners") >= SHARED_OWNERS, "example").when(F.col("owners") > 1, "unclear").when(F.col("live"), "live").otherwise("weak")
    known = each.join(F.broadcast(counts) if counts.count() <= BROADCAST_ROWS else counts, "hash").withColumn("verdict", verdict)
    one = known.groupBy("doc_id", "k", "hash").agg(F.max("owners").alias("owners"), F.max(F.col("verdict") == "live").alias("is_live"),
                                                  F.collect_list(F.struct("start", "rank", "end", "kind", "verdict")).alias("v"))
    judged = one.groupBy("doc_id", "k").agg(
        F.count_if(F.col("owners") >= SHARED_OWNERS).alias("n_shared"), F.count_if(F.col("owners") == 1).alias("n_owned"), F.count_if("is_live").alias("n_live"),
        F.array_join(F.transform(F.array_sort(F.flatten(F.collect_list("v"))), lambda s: F.concat_ws(":", s.kind, s.start, s.end, s.verdict)), ",").alias("verdicts"))
    judged = scratch.write(judged, "judged").select(F.col("doc_id").alias("_id"), F.col("k").alias("_k"), "verdicts", "n_shared", "n_owned", "n_live")

    own = F.filter("s", lambda x: x["rank"] < len(BASE_KINDS))
    number = lambda kind: F.size(F.filter("s", lambda x: x.kind == kind)).cast("long").alias(f"n_{kind}")
    out = found.select("doc_id", "k", *(number(k) for k in BASE_KINDS), F.sha2(_joined(own), 256).alias("base_sha256"), _joined(F.col("s")).alias("spans"), (F.size("s") > 0).alias("_any"))
    none = out.where("not _any").select("*", F.lit("").alias("verdicts"), *(F.lit(0).cast("long").alias(c) for c in ("n_shared", "n_owned", "n_live")))
    some = out.where("_any").join(judged, (F.col("k") == F.col("_k")) & F.col("doc_id").eqNullSafe(F.col("_id"))).drop("_id", "_k")
    return none.unionByName(some).drop("k", "_any")


def query(spark, sf_dir: str) -> DataFrame:
    return scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "secret-scan"))
