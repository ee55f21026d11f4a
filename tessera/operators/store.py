"""Content store: deduplicated appends, splitting and hydration of message bodies, link closure."""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def content_id(column: Column) -> Column:
    """Identifier of a text: SHA-256 in hexadecimal."""
    return F.sha2(column, 256)


def new_blobs(incoming: DataFrame, stored: DataFrame, order: str = "created_at") -> DataFrame:
    """Rows of ``incoming`` (cid, ...) whose cid isn't stored; the first of equal ones stays."""
    others = [c for c in incoming.columns if c not in ("cid", order)]
    first = incoming.groupBy("cid").agg(F.min(F.struct(order, *others)).alias("x")).select("cid", "x.*")
    return first.select(*incoming.columns).join(stored.select("cid"), "cid", "left_anti")


def split_bodies(bodies: DataFrame, elements: str = "messages") -> tuple[DataFrame, DataFrame]:
    """(blobs: cid, content once each; tops: body_id, cid, leaves: ordered cids) of (body_id, <elements> array<string>)."""
    leaves = bodies.select("body_id", F.posexplode(elements).alias("pos", "content")).withColumn("cid", content_id(F.col("content")))
    blobs = leaves.groupBy("cid").agg(F.min("content").alias("content"))
    tops = bodies.select("body_id", F.transform(elements, lambda x: F.sha2(x, 256)).alias("leaves"))
    return blobs, tops.select("body_id", F.sha2(F.concat_ws(",", "leaves"), 256).alias("cid"), "leaves")


def hydrate(tops: DataFrame, blobs: DataFrame) -> DataFrame:
    """(body_id, messages): leaves in order, missing ones left out."""
    places = tops.select("body_id", F.posexplode("leaves").alias("pos", "cid"))
    found = places.join(blobs.select("cid", "content"), "cid").groupBy("body_id").agg(F.array_sort(F.collect_list(F.struct("pos", "content"))).alias("x"))
    whole = found.select("body_id", F.transform("x", lambda m: m.content).alias("messages"))
    return tops.select("body_id").join(whole, "body_id", "left").select("body_id", F.coalesce("messages", F.array().cast("array<string>")).alias("messages"))


def kept(df: DataFrame) -> DataFrame:
    """``df`` as a checkpoint in the shared folder (``spark.checkpoint.dir``, or one of our own where it is unset)."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
    return df.checkpoint()


def closure(roots: DataFrame, links: DataFrame, depth: int | None = None) -> DataFrame:
    """(root, cid, depth) of everything that roots (root) reach over links (cid, target), least depth each.

    Links are followed until they lead to nothing new, at most ``depth`` times where it is given.
    """
    links = kept(links.select("cid", "target").distinct())
    edge = kept(roots.select("root", F.col("root").alias("cid"), F.lit(0).alias("depth")).distinct())
    parts, steps = [edge], 0
    while (depth is None or steps < depth) and not edge.isEmpty():
        steps += 1
        step = edge.join(links, "cid").select("root", F.col("target").alias("cid"), F.lit(steps).alias("depth")).distinct()
        seen = reduce(DataFrame.unionByName, parts)
        edge = kept(step.join(seen.select("root", "cid"), ["root", "cid"], "left_anti"))
        parts = [*parts, edge] if len(parts) < 16 else [kept(seen), edge]  # plans of long chains stay small
    return reduce(DataFrame.unionByName, parts)


def chunks(size: Column, chunk: int) -> Column:
    """Array of (number, offset, length) that an upload of ``size`` bytes is cut into."""
    n = F.greatest(F.ceil(size / F.lit(chunk)), F.lit(1)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(k.alias("number"), (k.cast("long") * chunk).alias("offset"), F.least(F.lit(chunk).cast("long"), size - k.cast("long") * chunk).alias("length")))


def valid_submission(lines: DataFrame) -> DataFrame:
    """(file_id, n_messages, problem) of JSON lines (file_id, line_no, line): each an object with role
    and content, the last an assistant's; blank lines don't count."""
    rows = lines.where(F.trim("line") != "").withColumn("v", F.try_parse_json(F.trim("line")))
    role = F.try_variant_get("v", "$.role", "string")
    content = F.try_variant_get("v", "$.content", "variant")
    bad = F.when(F.col("v").isNull(), "not JSON").when(~F.schema_of_variant("v").startswith("OBJECT"), "not an object").when(role.isNull() | content.isNull(), "no role or content")
    checked = rows.select("file_id", "line_no", role.alias("role"), bad.alias("bad"))
    out = checked.groupBy("file_id").agg(F.count("*").alias("n_messages"), F.min(F.when(F.col("bad").isNotNull(), F.struct("line_no", "bad"))).getField("bad").alias("first"), F.max_by("role", "line_no").alias("last"))
    return out.select("file_id", "n_messages", F.coalesce("first", F.when(~F.col("last").eqNullSafe("assistant"), "last is not an assistant's")).alias("problem"))
