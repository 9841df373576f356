"""Encoded features kept as tables in buckets of their key: joins on the key read them where they lie."""

from __future__ import annotations

import hashlib
import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.session import place

#: A key of more than one in this many pairs is hot; there are fewer hot keys than this, so their features are small.
HOT = 512


def input_print(files: DataFrame) -> str:
    """A fingerprint of the files that ``files``, a scan, reads: their names, sizes and times, not their rows."""
    names = files.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    row = names.select(F.xxhash64(*names.columns).cast("decimal(38,0)").alias("h")).agg(F.count("h").alias("n"), F.sum("h").alias("s")).first()
    return f"{row['n']}:{row['s']}"


def _manifest(base: str, tag: str):
    files, path = place(base)
    return files, f"{path}/features-{tag}/_manifest.json"


def manifest(base: str, tag: str) -> dict | None:
    """What the features of a tag were made of; None where they are not, or not yet whole."""
    files, path = _manifest(base, tag)
    try:
        with files.open_input_file(path) as f:
            return json.loads(f.read())
    except FileNotFoundError:
        return None


def feature_table(rows: DataFrame, key: str, base: str, made_of: dict[str, str], buckets: int | None = None) -> DataFrame:
    """``rows`` as a table in ``buckets`` of ``key`` below ``base``: written by the first call, only opened by later ones,
    also of other sessions.

    ``made_of`` names whatever the content hangs on (vocabulary, length, ``input_print`` of the files). Together with
    the schema, the key and the number of buckets it is the manifest, whose digest names the table; so any change makes a
    new table, and the old one stays. The manifest is written last: a table without it is written anew. One writer at a
    time. By default there are as many buckets as the session has shuffle partitions; a join with fewer may shuffle them.

    Rows without key: kept, found by no join. Empty ``rows``: an empty table.
    """
    spark: SparkSession = rows.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    about = {"key": key, "buckets": buckets, "schema": rows.schema.jsonValue(), **made_of}
    tag = hashlib.sha256(json.dumps(about, sort_keys=True).encode()).hexdigest()[:20]
    path, name = f"{base}/features-{tag}", f"features_{tag}_{hashlib.sha256(base.encode()).hexdigest()[:8]}"
    if manifest(base, tag) is None:
        # one task per bucket, so one file per bucket
        dealt = rows.repartition(buckets, key).write.mode("overwrite").format("parquet").option("path", path)
        dealt.bucketBy(buckets, key).sortBy(key).saveAsTable(name)
        files, where = _manifest(base, tag)
        with files.open_output_stream(where, compression=None) as out:
            out.write(json.dumps(about, sort_keys=True).encode())
    elif not spark.catalog.tableExists(name):
        ddl, at = rows._jdf.schema().toDDL(), path.replace("'", "\\'")
        spark.sql(f"CREATE TABLE {name} ({ddl}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{at}'")
    return spark.table(name)


def hot_keys(rows: DataFrame, key: str, share: int = HOT) -> list:
    """Values of ``key`` in more than one of ``share`` rows; counts are combined map-side, fewer than ``share`` come back."""
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return [r[0] for r in counts.join(F.broadcast(total)).where(F.col("n") * share > F.col("total")).select(key).collect()]


def with_features(rows: DataFrame, on: str, features: DataFrame, key: str, column: str, out: str, hot: list) -> DataFrame:
    """``rows`` with ``out``, the ``column`` of the row of ``features`` whose ``key`` is ``on``; rows without one go.

    ``features`` has one row per key and lies in buckets of it, so only ``rows`` move. A bucket is read by one task,
    whatever asks for it; so rows of the ``hot`` keys are joined apart, where they are, with those few features.
    """
    found = features.select(F.col(key).alias(on), F.col(column).alias(out))
    if not hot:
        return rows.join(found, on)
    few = rows.where(F.col(on).isin(hot)).join(F.broadcast(found.where(F.col(on).isin(hot))), on)
    return rows.where(~F.col(on).isin(hot)).join(found, on).unionByName(few)


def join_pair_features(pairs: DataFrame, features: DataFrame, key: str = "id", column: str = "ids", share: int = HOT) -> DataFrame:
    """(columns of pairs, ids): the features of ``url1``, then those of ``url2``.

    Features are never shuffled: pairs go to the buckets of the first id, and with its features to those of the second.
    A pair with a null or unknown id goes; repeated pairs stay. Other columns of pairs stay, whatever their names.
    """
    ends = [("url1", "__first"), ("url2", "__second")]
    hot = {on: hot_keys(pairs.select(on), on, share) for on, _ in ends}
    both = reduce(lambda rows, end: with_features(rows, end[0], features, key, column, end[1], hot[end[0]]), ends, pairs)
    own = [F.col(f"`{c}`") for c in pairs.columns if c != "ids"]
    return both.select(*own, F.concat("__first", "__second").alias("ids"))
