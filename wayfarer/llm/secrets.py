"""Secret scans with multipart credential linking, in DataFrame operations only.

Base kinds (assign, access, hex) are reported wherever they match. Of three further kinds - identifiers of
accounts, strings of 20 and more characters with digits and letters of both cases, and endpoints - each alone is weak, and none is reported on its own: an
interval join brings the parts together that lie within `scope` code points of each other, and a weak
secret is reported (linked) when an access identifier is in its scope, an endpoint when both an identifier
and a secret are. Parts are joined by stretches of scope code points, which a few dozen parts fill, so the
join stays linear however long a text is.

Defined cases: null text is empty; a null doc_id is kept; repeated rows get the same spans; rows without
secrets get empty span lists; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfarer.llm.common import by_key, fresh, stash, texts

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = {"assign": ASSIGN, "access": "AKIA[A-Z0-9]{12,}", "hex": "[0-9a-f]{32,}"}
IDENTITY = r"""(?i:access_?key_?id|client_?id|account_?id|username|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@+-]{3,}"""
WEAK = r"(?<![A-Za-z0-9/+_=-])(?=[A-Za-z/+_=-]*[0-9])(?=[a-z0-9/+_=-]*[A-Z])(?=[A-Z0-9/+_=-]*[a-z])[A-Za-z0-9/+_=-]{20,}(?![A-Za-z0-9/+_=-])"
#: Schemes are listed, or bounded: a pattern that starts with [a-z]+ would take the square of a long run of letters.
ENDPOINT = r"""(?:https?|s3|jdbc:[a-z]{1,20}|postgresql|mysql|mssql|mongodb|redis|amqp)://[^\s"'<>]+"""
#: Order of kinds at one start.
KINDS = ("assign", "access", "hex", "linked_secret", "linked_endpoint")


def _matches(kind: str, pattern: str, group: int | None = None, least: int = 0, only: Column | None = None) -> Column:
    """An array with kind, the lengths of the match and of the text before it since the last one, and if it counts."""
    found, parts = F.regexp_extract_all("text", F.lit(pattern), 0), F.split("text", pattern, -1)
    good = F.transform(F.regexp_extract_all("text", F.lit(pattern), group), lambda g: F.length(g) >= least) if group is not None else F.transform(found, lambda g: F.lit(True))
    zipped = F.arrays_zip(F.transform(found, F.length).alias("size"), F.transform(F.slice(parts, 1, F.size(found)), F.length).alias("gap"), good.alias("good"))
    rows = F.transform(zipped, lambda z, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), z["size"].alias("size"), z["gap"].alias("gap"), z["good"].alias("good")))
    none = F.array().cast("array<struct<kind:string,i:int,size:int,gap:int,good:boolean>>")
    return F.when(F.col("text").rlike(pattern) if only is None else only, rows).otherwise(none)


def parts(docs: DataFrame) -> DataFrame:
    """(k1, k2, kind, start, stop) of base matches, and of weak parts in texts that name an identity; code points."""
    rows = texts(docs).select("k1", "k2", "text")
    identity = F.col("text").rlike(IDENTITY) | F.col("text").contains("AKIA")
    some = F.col("text").rlike(ASSIGN) | F.col("text").rlike(BASE["access"]) | F.col("text").rlike(BASE["hex"]) | F.col("text").rlike(IDENTITY)
    rows = rows.where(some).dropDuplicates(["k1", "k2"])
    every = F.concat(
        _matches("assign", ASSIGN, 1, 8), _matches("access", BASE["access"]), _matches("hex", BASE["hex"]),
        _matches("identity", IDENTITY), _matches("weak", WEAK, only=identity & F.col("text").rlike(WEAK)), _matches("endpoint", ENDPOINT, only=identity & F.col("text").rlike(ENDPOINT)),
    )
    flat = rows.select("k1", "k2", F.explode(every).alias("x")).select("k1", "k2", "x.*")
    upto = Window.partitionBy("k1", "k2", "kind").orderBy("i")
    stop = F.sum(F.col("gap") + F.col("size")).over(upto)
    placed = flat.withColumn("stop", stop).where("good")
    return placed.select("k1", "k2", "kind", (F.col("stop") - F.col("size")).alias("start"), "stop")


def linked(found: DataFrame, scope: int = 400) -> DataFrame:
    """Weak secrets and endpoints with their complements in scope, as linked_secret and linked_endpoint."""
    weak = found.where(F.col("kind").isin("weak", "endpoint"))
    known = found.where(F.col("kind").isin("access", "identity", "assign", "weak"))

    def bins(low: Column, high: Column) -> Column:
        return F.explode(F.sequence(F.floor(low / scope), F.floor(high / scope))).alias("bin")

    # both sides go to every stretch they reach, as a complement may be longer than scope; a pair that meets twice counts once
    near = weak.select("*", bins(F.col("start") - scope, F.col("stop") + scope))
    other = known.select("k1", "k2", F.col("kind").alias("with"), F.col("start").alias("from"), F.col("stop").alias("to"), bins(F.col("start"), F.col("stop")))
    met = near.join(other, ["k1", "k2", "bin"]).where((F.col("from") - F.col("stop") <= scope) & (F.col("start") - F.col("to") <= scope) & ((F.col("from") != F.col("start")) | (F.col("with") != F.col("kind"))))
    sides = met.groupBy("k1", "k2", "kind", "start", "stop").agg(F.bool_or(F.col("with").isin("access", "identity")).alias("who"), F.bool_or(F.col("with").isin("assign", "weak")).alias("what"))
    sides = sides.where("who and (kind = 'weak' or what)")
    return sides.select("k1", "k2", F.when(F.col("kind") == "weak", "linked_secret").otherwise("linked_endpoint").alias("kind"), "start", "stop")


def spans(docs: DataFrame, scope: int = 400) -> DataFrame:
    """(k1, k2, spans): all reported spans of a row, by start and then kind. The parts are matched once, and read from the shared folder."""
    found = stash(parts(docs), "secret-parts")
    base = found.where(F.col("kind").isin(*BASE))
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    both = base.unionByName(linked(found, scope)).select("k1", "k2", F.struct("start", rank.alias("rank"), "stop", "kind").alias("s"))
    # small beside the texts: as a written table its size is known, so that Spark broadcasts it to them where it may
    return stash(both.groupBy("k1", "k2").agg(F.sort_array(F.collect_list("s")).alias("spans")), "secret-spans")


def _listed(of: Column) -> Column:
    return F.array_join(F.transform(of, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def scanned(docs: DataFrame, scope: int = 400) -> DataFrame:
    rows = texts(docs).select("doc_id", "k1", "k2").join(spans(docs, scope), ["k1", "k2"], "left")
    every = F.coalesce("spans", F.array().cast("array<struct<start:bigint,rank:bigint,stop:bigint,kind:string>>"))

    def count(kind: str) -> Column:
        return F.size(F.filter(every, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter(every, lambda s: s["kind"].isin(*BASE))
    return rows.select("doc_id", *map(count, BASE), F.sha2(_listed(base), 256).alias("base_sha256"), _listed(every).alias("spans"))


def redacted(docs: DataFrame, scope: int = 400, mask: str = "[SECRET]") -> DataFrame:
    """docs with every reported span replaced by the mask, overlapping ones together, and n_chars counted anew where it exists."""
    own = fresh(docs, 5)[-1]  # by_key takes the first four
    full = by_key(docs, spans(docs, scope).withColumnRenamed("spans", own), "left")
    start = F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("at"))

    def step(acc: Column, s: Column) -> Column:
        kept = F.when(s["start"] >= acc["at"], F.concat(acc["done"], F.substr(F.col("text"), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(mask))).otherwise(acc["done"])
        return F.struct(kept.alias("done"), F.greatest(acc["at"], s["stop"]).alias("at"))

    text = F.aggregate(own, start, step, lambda acc: F.concat(acc["done"], F.substr(F.col("text"), (acc["at"] + 1).cast("int"), F.lit(2**31 - 1))))
    out = full.withColumn("text", F.when(F.col(own).isNull(), F.col("text")).otherwise(text)).drop(own)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out
