"""A typed directed multigraph as immutable tables, and its snapshots on a shared file system.

Every change gives a new `Graph`; readers of an old one are never disturbed.  `seq` keeps the order in which a
vertex got its edges: the number of the batch in the high bits, the place in the batch in the low ones, so
that appending needs no global numbering.  `publish` writes a version and then moves the manifest that
names it; until that move readers see the version before.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trellium.storage import cut, if_small, numbered

VERTEX = "vid long, label_id int, deleted boolean"
EDGE = "src long, dst long, type_id int, seq long, deleted boolean"
SHIFT = 32
RELATED_TO = 1


@dataclass(frozen=True)
class Graph:
    vertices: DataFrame
    edges: DataFrame
    types: DataFrame
    #: (ext_id, vid); with identity the two are equal and joins with it are skipped.
    ids: DataFrame
    next_vid: int = 0
    batch: int = 0
    identity: bool = False

    @property
    def live_vertices(self) -> DataFrame:
        return self.vertices.where("not deleted")

    @property
    def live(self) -> DataFrame:
        """Visible edges. An edge into a deleted vertex stays visible; a deleted vertex has no out-edges."""
        return self.edges.where("not deleted").drop("deleted")


def empty(spark: SparkSession) -> Graph:
    return Graph(
        spark.createDataFrame([], VERTEX),
        spark.createDataFrame([], EDGE),
        spark.createDataFrame([(RELATED_TO, "related_to")], "id int, name string"),
        spark.createDataFrame([], "ext_id long, vid long"),
    )


def from_edges(spark: SparkSession, edges: DataFrame, vertices: int) -> Graph:
    """A graph whose vertices are 0 .. vertices - 1 and whose edges(src, dst, type_id, seq) are given."""
    v = spark.range(vertices).select(F.col("id").alias("vid"), F.lit(1).alias("label_id"), F.lit(False).alias("deleted"))
    e = edges.select("src", "dst", "type_id", F.col("seq").cast("long").alias("seq"), F.lit(False).alias("deleted"))
    return replace(empty(spark), vertices=v, edges=e, next_vid=vertices, batch=1, identity=True)


def insert_vertices(g: Graph, n: int = 1) -> Graph:
    new = g.vertices.sparkSession.range(g.next_vid, g.next_vid + n).select(F.col("id").alias("vid"), F.lit(1).alias("label_id"), F.lit(False).alias("deleted"))
    return replace(g, vertices=g.vertices.unionByName(new), next_vid=g.next_vid + n)


def insert_edges(g: Graph, new: DataFrame) -> Graph:
    """Appends new(src, dst[, type_id][, pos]) in the order of pos; an unknown or deleted endpoint is an error and nothing is appended."""
    if "type_id" not in new.columns:
        new = new.withColumn("type_id", F.lit(RELATED_TO))
    if "pos" not in new.columns:
        new = new.withColumn("pos", F.lit(0))
    new = new.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.col("type_id").cast("int").alias("type_id"), "pos")
    for end in ("dst", "src"):
        lost = new.join(g.live_vertices.select(F.col("vid").alias(end)), end, "left_anti").take(1)
        if lost:
            raise ValueError(f"{end} {lost[0][end]} is not a visible vertex")
    place = F.row_number().over(Window.partitionBy("src").orderBy("pos", "type_id", "dst"))
    rows = new.select("src", "dst", "type_id", (F.lit(g.batch).cast("long") * (1 << SHIFT) + place).alias("seq"), F.lit(False).alias("deleted"))
    return replace(g, edges=g.edges.unionByName(rows), batch=g.batch + 1)


def insert_edge(g: Graph, src: int, dst: int, type_id: int = RELATED_TO) -> Graph:
    return insert_edges(g, g.edges.sparkSession.createDataFrame([(src, dst, type_id)], "src long, dst long, type_id int"))


def insert_adjacency(g: Graph, src: int, dst: list[int], type_id: int = RELATED_TO) -> tuple[Graph, int]:
    """The edges of one source in the order of an array; gives how many."""
    if any(d is None for d in dst):
        raise ValueError("a null destination")
    if not dst:
        return g, 0
    rows = g.edges.sparkSession.createDataFrame([(src, d, type_id, i) for i, d in enumerate(dst)], "src long, dst long, type_id int, pos long")
    return insert_edges(g, rows), len(dst)


def register_types(g: Graph, names: list[str]) -> tuple[Graph, dict[str, int]]:
    """Ids of the named types; new names take the ids after the largest, in the order given."""
    known = {r["name"]: r["id"] for r in g.types.collect()}  # a dictionary of types, small by definition
    top = max(known.values(), default=0)
    for n in names:
        if n not in known:
            top += 1
            known[n] = top
    types = g.types.sparkSession.createDataFrame([(i, n) for n, i in known.items()], "id int, name string")
    return replace(g, types=types), {n: known[n] for n in names}


def upsert_vertices(g: Graph, ext: DataFrame) -> Graph:
    """Vertices for those of ext(ext_id) that have none yet, densely numbered in the order of ext_id."""
    if g.identity:
        raise ValueError("external ids are the vertex ids; insert vertices instead")
    new = ext.select(F.col("ext_id").cast("long").alias("ext_id")).where("ext_id is not null").distinct().join(g.ids, "ext_id", "left_anti")
    made = cut(numbered(new, ["ext_id"], "vid", g.next_vid))
    n = made.count()
    rows = made.select("vid", F.lit(1).alias("label_id"), F.lit(False).alias("deleted"))
    return replace(g, vertices=g.vertices.unionByName(rows), ids=g.ids.unionByName(made.select("ext_id", "vid")), next_vid=g.next_vid + n)


def add_edges(g: Graph, ext_edges: DataFrame) -> Graph:
    """Edges of type 1 between external ids (src, dst[, pos]); missing endpoints are made."""
    g = upsert_vertices(g, ext_edges.select(F.col("src").alias("ext_id")).unionAll(ext_edges.select(F.col("dst").alias("ext_id"))))
    ids = g.ids
    named = ext_edges.withColumnsRenamed({"src": "xs", "dst": "xd"}).join(ids.select(F.col("ext_id").alias("xs"), F.col("vid").alias("src")), "xs")
    named = named.join(ids.select(F.col("ext_id").alias("xd"), F.col("vid").alias("dst")), "xd").drop("xs", "xd")
    return insert_edges(g, named)


def tombstone_edges(g: Graph, gone: DataFrame) -> Graph:
    """Marks every visible edge that matches a row of gone(src, dst[, type_id]); type 0 is any; absent edges change nothing."""
    if "type_id" not in gone.columns:
        gone = gone.withColumn("type_id", F.lit(RELATED_TO))
    gone = gone.select(F.col("src").alias("gs"), F.col("dst").alias("gd"), F.col("type_id").alias("gt")).distinct()
    # one flag for each pair, so that no edge is joined twice
    by = gone.groupBy("gs", "gd").agg(F.collect_set("gt").alias("gt"))
    hit = F.array_contains("gt", F.lit(0)) | F.array_contains("gt", F.col("type_id"))
    e = g.edges.join(by, (F.col("src") == F.col("gs")) & (F.col("dst") == F.col("gd")), "left")
    e = e.withColumn("deleted", F.col("deleted") | F.coalesce(hit, F.lit(False))).drop("gs", "gd", "gt")
    return replace(g, edges=e)


def remove_edges(g: Graph, ext_edges: DataFrame) -> Graph:
    """tombstone_edges by external ids; unmapped endpoints are ignored."""
    ids = g.ids
    gone = ext_edges.select(F.col("src").alias("xs"), F.col("dst").alias("xd")).join(ids.select(F.col("ext_id").alias("xs"), F.col("vid").alias("src")), "xs")
    gone = gone.join(ids.select(F.col("ext_id").alias("xd"), F.col("vid").alias("dst")), "xd").select("src", "dst")
    return tombstone_edges(g, gone)


def tombstone_vertices(g: Graph, gone: DataFrame) -> Graph:
    """Deletes vertices gone(vid) and their out-edges; edges into them stay and are still followed."""
    flag = if_small(gone.select(F.col("vid").alias("gv")).where("gv is not null").distinct(), 16).withColumn("hit", F.lit(True))
    dead = F.col("deleted") | F.coalesce("hit", F.lit(False))
    v = g.vertices.join(flag, F.col("vid") == F.col("gv"), "left").withColumn("deleted", dead).select(g.vertices.columns)
    e = g.edges.join(flag, F.col("src") == F.col("gv"), "left").withColumn("deleted", dead).select(g.edges.columns)
    return replace(g, vertices=v, edges=e)


def freeze(g: Graph) -> Graph:
    """The same answers from tables without their history of plans: a compaction."""
    return replace(g, vertices=cut(g.vertices), edges=cut(g.edges.repartition("src").sortWithinPartitions("src", "seq")), ids=cut(g.ids))


def set_identity(g: Graph, on: bool) -> Graph:
    if on and not g.ids.where("ext_id <> vid").isEmpty():
        raise ValueError("some external id differs from its vertex id")
    return replace(g, identity=on)


def counts(g: Graph) -> DataFrame:
    """One row: visible vertices and edges, edges ever inserted, ids ever given."""
    v = g.vertices.agg(F.count(F.when(~F.col("deleted"), 1)).alias("vertex_count"))
    e = g.edges.agg(F.count("*").alias("edge_count"), F.count(F.when(~F.col("deleted"), 1)).alias("visible_edge_count"))
    return v.crossJoin(e).withColumn("allocated_vids", F.lit(g.next_vid).cast("long"))


def dump_vertices(g: Graph) -> DataFrame:
    return g.vertices.sparkSession.range(g.next_vid).select(F.col("id").alias("vid"))


def dump_edges(g: Graph) -> DataFrame:
    return g.live.orderBy("src", "type_id", "seq").select("src", "dst", "type_id")


def adjacency(g: Graph) -> DataFrame:
    """(vid, nbrs): out-neighbours of each vertex in one array, in order."""
    by = g.live.groupBy(F.col("src").alias("vid")).agg(F.sort_array(F.collect_list(F.struct("seq", "dst"))).alias("e"))
    return by.select("vid", F.col("e.dst").alias("nbrs"))


def visible(log: DataFrame, txns: DataFrame) -> DataFrame:
    """Visible edges of log(txn, op, src, dst, type_id, seq), op insert or delete, by txns(txn, committed).

    An insert counts if its transaction is committed; it is gone if a committed transaction deleted that edge.
    """
    done = log.join(txns.where("committed").select("txn"), "txn", "left_semi")
    gone = done.where("op = 'delete'").select("src", "dst", "type_id", "seq").distinct()
    return done.where("op = 'insert'").select("src", "dst", "type_id", "seq").join(gone, ["src", "dst", "type_id", "seq"], "left_anti")


def _fs(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


class Store:
    """Versions of a graph below one folder. One writer at a time; readers never wait."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def lock(self) -> None:
        fs, root = _fs(self.spark, self.folder)
        fs.mkdirs(root)
        try:
            fs.create(self._path("writer.lock"), False).close()
        except Exception as e:
            raise RuntimeError("another writer holds the store") from e

    def unlock(self) -> None:
        _fs(self.spark, self.folder)[0].delete(self._path("writer.lock"), False)

    def version(self) -> dict | None:
        fs, _ = _fs(self.spark, self.folder)
        if not fs.exists(self._path("CURRENT")):
            return None
        return json.loads(self.spark.read.text(f"{self.folder}/CURRENT", wholetext=True).first()[0])

    def publish(self, g: Graph, **tables: DataFrame) -> int:
        """Writes the graph, and any entity tables with it, and makes them the current version together."""
        self.lock()
        try:
            n = (self.version() or {"version": 0})["version"] + 1
            at = f"{self.folder}/v{n}"
            parts = {"vertices": g.vertices, "edges": g.edges.repartition("src").sortWithinPartitions("src", "seq"), "types": g.types, "ids": g.ids} | tables
            for name, df in parts.items():
                df.write.mode("overwrite").parquet(f"{at}/{name}")
            fs, _ = _fs(self.spark, self.folder)
            out = fs.create(self._path(f"CURRENT.{n}"), True)
            out.write(bytearray(json.dumps({"version": n, "next_vid": g.next_vid, "batch": g.batch, "identity": g.identity, "tables": sorted(tables)}).encode()))
            out.close()
            options = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
            context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("CURRENT").toUri(), self.spark._jsc.hadoopConfiguration())
            over = self.spark.sparkContext._gateway.new_array(options, 1)
            over[0] = options.OVERWRITE
            context.rename(self._path(f"CURRENT.{n}"), self._path("CURRENT"), over)
            return n
        finally:
            self.unlock()

    def load(self, version: int | None = None) -> Graph:
        m = self.version()
        if m is None:
            raise ValueError(f"no version in {self.folder}")
        at = f"{self.folder}/v{version or m['version']}"
        read = self.spark.read.parquet
        return Graph(read(f"{at}/vertices"), read(f"{at}/edges"), read(f"{at}/types"), read(f"{at}/ids"), m["next_vid"], m["batch"], m["identity"])

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/v{self.version()['version']}/{name}")
