"""Collections as Parquet tables that are appended to.

A collection is a folder with a log of numbered versions (``log/<number>.json``), a base table whose ids are distinct, and
a folder of Parquet for each write since.  A write appends its rows, deletions being rows too, and then adds the next
version to the log, which fails if another writer has added it meanwhile; the write then takes the number after that.  So
readers never see half a write, no write is lost, a lost job leaves the last version whole, and a write reads nothing old.
Of the rows of one id the last written counts.  ``compact`` makes a new base of what there is.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, FloatType, LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from ..functions.filters import resolver, compile_filter
from ..functions.metrics import MAX_DIMENSIONS, IndexType, Metric
from ..operators.embed import VectorizerConfig, embed_column, embed_query
from ..operators.search import SearchRequest, candidates, clamp_limit, knn
from ..plans.cache import ResultCache

SCHEMA = StructType([StructField("id", StringType()), StructField("vector", ArrayType(FloatType())), StructField("metadata", StringType()), StructField("content", StringType()), StructField("_seq", LongType())])

#: Changed ids that are sent to each task, so that the base isn't shuffled.
SMALL = 500_000


class LatticaError(Exception):
    """Base of the errors below."""


class NotFound(LatticaError):
    pass


class AlreadyExists(LatticaError):
    pass


class InvalidRequest(LatticaError, ValueError):
    pass


class Conflict(LatticaError):
    """Another writer was faster."""


@dataclass(frozen=True)
class ContentStorage:
    enabled: bool = True
    field: str = "_content"
    max_size: int = 1 << 20
    compressed: bool = False

    def __post_init__(self):
        if not self.field or self.max_size < 0:
            raise InvalidRequest("content storage needs a field name and a size that isn't negative")


@dataclass(frozen=True)
class CollectionMeta:
    name: str
    dimensions: int
    metric: int = 0
    index_type: int = 0
    content_storage: ContentStorage = field(default_factory=ContentStorage)
    vectorizer: dict | None = None
    config: dict = field(default_factory=dict)
    created: float = 0.0
    modified: float = 0.0
    version: int = 0
    base: str | None = None
    deltas: tuple[str, ...] = ()
    delta_rows: int = 0


class _Files:
    """The few small files of a catalog, through Hadoop's file system, so that any shared storage will do."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, path: str, text: str) -> None:
        """A whole new file, or none: written beside its place and renamed to it, which fails where there is one."""
        fs, p = self._at(f"{path}.{uuid.uuid4().hex}.tmp")
        stream = fs.create(p, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.conf)
        target, options = fs.makeQualified(self.jvm.org.apache.hadoop.fs.Path(path)), self.jvm.org.apache.hadoop.fs.Options
        try:
            context.rename(fs.makeQualified(p), target, self._no_options(options))
        except Exception as e:
            fs.delete(p, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(path) from None
            raise

    def _no_options(self, options):
        from pyspark import SparkContext

        return SparkContext._gateway.new_array(options.Rename, 0)

    def rename(self, source: str, target: str) -> None:
        fs, p = self._at(target)
        fs.mkdirs(p.getParent())
        if not fs.rename(self.jvm.org.apache.hadoop.fs.Path(source), p):
            raise OSError(f"cannot write {target}")

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def folders(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []

    def names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def size(self, path: str) -> int:
        fs, p = self._at(path)
        return fs.getContentSummary(p).getLength() if fs.exists(p) else 0

    def copy(self, source: str, target: str) -> None:
        (fs, a), (gs, b) = self._at(source), self._at(target)
        self.jvm.org.apache.hadoop.fs.FileUtil.copy(fs, a, gs, b, False, self.conf)


def latest(rows: DataFrame, id_col: str = "id", *order: str) -> DataFrame:
    """Of the rows of one id the last written, by the columns of ``order``."""
    w = Window.partitionBy(id_col).orderBy(*[F.desc(c) for c in order or ("_seq",)])
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def upsert(old: DataFrame, new: DataFrame, id_col: str = "id") -> DataFrame:
    """``old`` with the rows of ``new``, which replace those of the same id."""
    return old.join(new.select(id_col), id_col, "left_anti").unionByName(new)


class Collection:
    def __init__(self, db: Database, meta: CollectionMeta):
        self.db, self.meta = db, meta

    @property
    def spark(self) -> SparkSession:
        return self.db.spark

    @property
    def path(self) -> str:
        return f"{self.db.root}/{self.meta.name}"

    def refresh(self) -> CollectionMeta:
        """The newest version, also where another handle or process has written it."""
        self.meta = self.db._newest(self.meta.name)
        return self.meta

    def rows(self) -> DataFrame:
        """``id, vector, metadata`` (JSON), ``content, _seq`` of the newest version."""
        return self._rows(self.refresh())

    def _rows(self, meta: CollectionMeta) -> DataFrame:
        base = self.spark.createDataFrame([], SCHEMA) if meta.base is None else self.spark.read.schema(SCHEMA).parquet(f"{self.path}/{meta.base}")
        if not meta.deltas:
            return base
        written = StructType([*SCHEMA.fields, StructField("_deleted", BooleanType()), StructField("c", StringType())])
        new = self.spark.read.schema(written).option("basePath", f"{self.path}/delta").parquet(*[f"{self.path}/delta/{x}" for x in meta.deltas])
        new = latest(new, "id", "c", "_seq")
        alive = new.where("NOT _deleted").select(*SCHEMA.names)
        if meta.base is None:
            return alive
        changed = new.select("id")
        return base.join(F.broadcast(changed) if meta.delta_rows <= SMALL else changed, "id", "left_anti").select(*SCHEMA.names).unionByName(alive)

    def _commit(self, change, attempts: int = 20) -> None:
        """Add the version that ``change`` makes of the newest one and its number; again, if another writer was faster."""
        for _ in range(attempts):
            old = self.refresh()
            new = change(replace(old, version=old.version + 1, modified=time.time()))
            try:
                self.db._add(new)
            except Conflict:
                continue
            self.meta = new
            return
        raise Conflict(f"{self.meta.name}: {attempts} attempts")

    def _append(self, folder: str, n: int) -> None:
        """Make the rows of a folder part of the collection."""
        place = [folder]

        def change(meta: CollectionMeta) -> CollectionMeta:
            name = f"c={meta.version:012d}-{uuid.uuid4().hex[:8]}"  # the order of writes, which readers take from the path
            self.db.files.rename(place[0], f"{self.path}/delta/{name}")
            place[0] = f"{self.path}/delta/{name}"
            return replace(meta, deltas=(*meta.deltas, name), delta_rows=meta.delta_rows + n)

        self._commit(change)

    def _staged(self) -> str:
        return f"{self.path}/staged-{uuid.uuid4().hex}"

    # writing

    def _shaped(self, rows: DataFrame) -> DataFrame:
        """Rows in the collection's form; ``_seq`` tells which of equal ids comes last."""
        names = rows.columns
        has = lambda c: c in names
        kind = rows.schema["metadata"].dataType if has("metadata") else None
        metadata = F.lit("{}") if kind is None else F.coalesce(F.col("metadata") if isinstance(kind, StringType) else F.to_json("metadata"), F.lit("{}"))
        order = (F.col("_order") if has("_order") else F.monotonically_increasing_id()).cast("bigint")
        return rows.select(
            F.col("id").cast("string").alias("id"), F.col("vector").cast("array<float>").alias("vector"), metadata.alias("metadata"), (F.col("content") if has("content") else F.lit(None).cast("string")).alias("content"),
            order.alias("_seq"), F.lit(False).alias("_deleted"),
        )

    def _check(self, rows: DataFrame) -> int:
        """All rows are good, or none is written."""
        limit = self.meta.content_storage.max_size if self.meta.content_storage.enabled else 0
        bad_id = F.col("id").isNull() | (F.col("id") == "")
        bad_vector = F.col("vector").isNull() | (F.size("vector") != self.meta.dimensions) | F.exists("vector", lambda x: x.isNull())
        bad_content = (F.octet_length("content") > limit) if limit else F.lit(False)
        n = rows.agg(F.count("*").alias("n"), F.count_if(bad_id).alias("ids"), F.count_if(bad_vector).alias("vectors"), F.count_if(F.coalesce(bad_content, F.lit(False))).alias("contents")).first()
        if n.ids or n.vectors or n.contents:
            raise InvalidRequest(f"{n.ids} rows without id, {n.vectors} without {self.meta.dimensions} dimensions, {n.contents} with too long a content; nothing was written")
        return n.n

    def insert_dataframe(self, rows: DataFrame) -> None:
        """Upsert ``id, vector[, metadata, content, _order]``; later rows win over earlier ones of the same id.

        ``rows`` is computed once: it is written, what was written is checked, and only then made part of the collection.
        """
        staged = self._staged()
        self._shaped(rows).write.parquet(staged)
        try:
            n = self._check(self.spark.read.parquet(staged))
            if n:
                self._append(staged, n)
        finally:
            self.db.files.delete(staged)

    def _local(self, items: list[dict]) -> DataFrame:
        made = [(x.get("id"), [float(v) for v in x["vector"]] if x.get("vector") is not None else None, json.dumps(x.get("metadata") or {}), x.get("content"), k) for k, x in enumerate(items)]
        return self.spark.createDataFrame(made, "id string, vector array<float>, metadata string, content string, _order bigint")

    def insert(self, id: str, vector, metadata: dict | None = None) -> None:  # noqa: A002
        self.insert_batch([{"id": id, "vector": vector, "metadata": metadata}])

    def insert_batch(self, items: list[dict]) -> None:
        self.insert_dataframe(self._local(items))

    def _vectorizer(self) -> VectorizerConfig:
        if self.meta.vectorizer is None:
            raise InvalidRequest(f"collection {self.meta.name} has no vectorizer")
        return VectorizerConfig(**{"dimensions": self.meta.dimensions} | self.meta.vectorizer)

    def insert_text_dataframe(self, rows: DataFrame) -> int:
        """Embed and upsert ``id, text[, metadata]``; returns how many texts couldn't be embedded and weren't written."""
        embedded, staged = embed_column(rows, self._vectorizer()), self._staged()
        if self.meta.content_storage.enabled:
            embedded = embedded.withColumn("content", F.col("text"))
        if "_order" not in embedded.columns:
            embedded = embedded.withColumn("_order", F.monotonically_increasing_id())
        embedded.drop("text").write.parquet(staged)  # each text is embedded once
        try:
            embedded = self.spark.read.parquet(staged)
            failed = embedded.where("vector IS NULL").count()
            self.insert_dataframe(embedded.where("vector IS NOT NULL").drop("embed_error"))
        finally:
            self.db.files.delete(staged)
        return failed

    def insert_text(self, id: str, text: str, metadata: dict | None = None) -> None:  # noqa: A002
        if self.insert_text_batch([{"id": id, "text": text, "metadata": metadata}]):
            raise LatticaError("the text could not be embedded")

    def insert_text_batch(self, items: list[dict]) -> int:
        made = [(x["id"], x["text"], json.dumps(x.get("metadata") or {}), k) for k, x in enumerate(items)]
        return self.insert_text_dataframe(self.spark.createDataFrame(made, "id string, text string, metadata string, _order bigint"))

    def _delete(self, ids: DataFrame) -> int:
        """Write rows that say that these ids are gone; their number."""
        staged = self._staged()
        gone = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in SCHEMA.fields}
        ids.select(F.col("id"), *[c for k, c in gone.items() if k not in ("id", "_seq")], F.lit(0).cast("bigint").alias("_seq"), F.lit(True).alias("_deleted")).write.parquet(staged)
        try:
            n = self.spark.read.parquet(staged).count()
            if n:
                self._append(staged, n)
        finally:
            self.db.files.delete(staged)
        return n

    def delete(self, id: str) -> None:  # noqa: A002
        if not self._delete(self.rows().where(F.col("id") == id)):
            raise NotFound(id)

    def delete_where(self, spec: dict) -> int:
        """Delete the rows for which a filter holds; returns their number."""
        rows = self.rows()
        return self._delete(rows.where(compile_filter(spec, resolver(rows, "metadata"))))

    def delete_document(self, filename: str | None = None, title: str | None = None, url: str | None = None) -> int:
        """Delete a document's rows by the first of these that is given."""
        for name, value in (("filename", filename), ("title", title), ("url", url)):
            if value:
                return self.delete_where({name: value})
        raise InvalidRequest("a filename, title or url is needed")

    def compact(self, files: int | None = None) -> None:
        """Make a new base of the newest version, in ``files`` files if given, and drop what no later version needs.

        What is written while it runs stays on top of the new base.
        """
        old, base = self.refresh(), f"base-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        rows = self._rows(old)
        (rows.coalesce(files) if files else rows).write.parquet(f"{self.path}/{base}")
        n = self.spark.read.parquet(*[f"{self.path}/delta/{x}" for x in old.deltas]).count() if old.deltas else 0

        def change(meta: CollectionMeta) -> CollectionMeta:
            if meta.base != old.base:
                raise InvalidRequest("another compaction was faster")
            return replace(meta, base=base, deltas=meta.deltas[len(old.deltas) :], delta_rows=meta.delta_rows - n)

        self._commit(change)
        for x in [*([old.base] if old.base else []), *[f"delta/{d}" for d in old.deltas]]:
            self.db.files.delete(f"{self.path}/{x}")
        self.db._forget(self.meta)

    def set_content_storage(self, storage: ContentStorage) -> None:
        self._commit(lambda meta: replace(meta, content_storage=storage))

    # reading

    def get(self, id: str) -> dict:  # noqa: A002
        row = self.rows().where(F.col("id") == id).first()
        if row is None:
            raise NotFound(id)
        return {"id": row.id, "vector": list(row.vector), "metadata": self._metadata(row.metadata, row.content), "content": row.content}

    def _metadata(self, text: str | None, content: str | None) -> dict:
        out = json.loads(text or "{}")
        if content is not None and self.meta.content_storage.enabled:
            out.setdefault(self.meta.content_storage.field, content)
        return out

    def count(self) -> int:
        return self.rows().count()

    def search_plan(self, request: SearchRequest) -> DataFrame:
        """The search as a DataFrame, for further use in plans."""
        request.validate(self.meta.dimensions)
        rows = self.rows().withColumn("content", F.coalesce("content", F.get_json_object("metadata", f"$.{self.meta.content_storage.field}")))
        return knn(rows, request, self.meta.metric)

    def search(self, vector, limit: int | None = 10, offset: int = 0, **options) -> dict:
        """``results`` and ``total``, the number of rows that were ranked; from the cache where this version was asked the same."""
        request = SearchRequest([float(x) for x in vector], clamp_limit(limit), offset, **options)

        def run() -> dict:
            results = []
            for row in self.search_plan(request).collect():
                r = row.asDict()
                if "metadata" in r:
                    r["metadata"] = self._metadata(r["metadata"], r.get("content"))
                results.append(r)
            return {"results": results, "total": candidates(self.rows(), request.filter).first().total}

        self.refresh()
        return self.db.cache.through((self.meta.name, self.meta.created, self.meta.version), request, run)

    def search_text(self, query: str, limit: int | None = 10, **options) -> dict:
        return self.search(embed_query(query, self._vectorizer()), limit, **{"include_metadata": True, "include_content": True} | options)

    def info(self) -> dict:
        m = self.meta
        return {"name": m.name, "dimensions": m.dimensions, "metric": Metric(m.metric).name.lower(), "index_type": IndexType(m.index_type).name.lower(), "vector_count": self.count(), "created": m.created, "modified": m.modified, "bytes": self.db.files.size(self.path)}


class Database:
    """Collections under one folder."""

    def __init__(self, spark: SparkSession, root: str, cache: ResultCache | None = None):
        self.spark, self.root, self.files = spark, root.rstrip("/"), _Files(spark)
        self.closed, self.cache = False, cache or ResultCache()
        self.started = time.time()

    def _add(self, meta: CollectionMeta, root: str | None = None) -> None:
        """Add a version to the log; Conflict if it is there."""
        self.files.create(f"{root or self.root}/{meta.name}/log/{meta.version:012d}.json", json.dumps(asdict(meta)))

    def _versions(self, name: str) -> list[str]:
        return [x for x in self.files.names(f"{self.root}/{name}/log") if x.endswith(".json")]

    def _newest(self, name: str) -> CollectionMeta:
        for _ in range(5):  # a compaction may delete old entries between the listing and the reading
            found = self._versions(name)
            if not found:
                raise NotFound(name)
            try:
                held = json.loads(self.files.read(f"{self.root}/{name}/log/{found[-1]}"))
            except Exception as e:
                if "FileNotFound" not in str(e):
                    raise
                continue
            return CollectionMeta(**held | {"content_storage": ContentStorage(**held["content_storage"]), "deltas": tuple(held["deltas"])})
        raise NotFound(name)

    def _forget(self, meta: CollectionMeta) -> None:
        """Delete the log's entries before a version."""
        for x in self._versions(meta.name):
            if x < f"{meta.version:012d}.json":
                self.files.delete(f"{self.root}/{meta.name}/log/{x}")

    def _open(self) -> None:
        if self.closed:
            raise LatticaError("the database is closed")

    def create(self, name: str, dimensions: int, metric=Metric.COSINE, index_type=IndexType.FLAT, content_storage: ContentStorage | dict | None = None, vectorizer: dict | None = None, config: dict | None = None) -> Collection:
        self._open()
        if not name or "/" in name or name.startswith("."):
            raise InvalidRequest("a collection needs a name without slashes")
        if not 1 <= dimensions <= MAX_DIMENSIONS:
            raise InvalidRequest(f"dimensions must lie between 1 and {MAX_DIMENSIONS}")
        try:
            metric, index_type = Metric.parse(metric), IndexType.parse(index_type)
        except ValueError as e:
            raise InvalidRequest(str(e)) from None
        storage = content_storage if isinstance(content_storage, ContentStorage) else ContentStorage(**content_storage or {})
        if self._versions(name):
            raise AlreadyExists(name)
        now = time.time()
        meta = CollectionMeta(name, dimensions, int(metric), int(index_type), storage, vectorizer, config or {}, now, now)
        try:
            self._add(meta)
        except Conflict:
            raise AlreadyExists(name) from None
        return Collection(self, meta)

    def collection(self, name: str) -> Collection:
        self._open()
        return Collection(self, self._newest(name))

    def names(self) -> list[str]:
        self._open()
        return [x for x in self.files.folders(self.root) if self._versions(x)]

    def list(self) -> DataFrame:
        """``name, dimensions, metric, index_type, created, modified``, by name."""
        metas = [self.collection(x).meta for x in self.names()]
        rows = [(m.name, m.dimensions, Metric(m.metric).name.lower(), IndexType(m.index_type).name.lower(), m.created, m.modified) for m in metas]
        return self.spark.createDataFrame(rows, "name string, dimensions int, metric string, index_type string, created double, modified double")

    def drop(self, name: str) -> None:
        self.collection(name)
        self.files.delete(f"{self.root}/{name}")

    def import_json(self, name: str, path: str, dimensions: int, **options) -> Collection:
        """A collection from one JSON object of id to ``{vector, metadata}``, as embedded stores dump it."""
        text = self.spark.read.text(path, wholetext=True)
        entries = text.select(F.explode(F.from_json("value", "map<string, struct<vector: array<float>, metadata: string>>")).alias("id", "held"))
        made = self.create(name, dimensions, **options)
        made.insert_dataframe(entries.select("id", "held.vector", "held.metadata"))
        return made

    def stats(self) -> dict:
        infos = [self.collection(x).info() for x in self.names()]
        return {"collections": infos, "total_vectors": sum(i["vector_count"] for i in infos), "total_bytes": sum(i["bytes"] for i in infos), "cache": self.cache.stats()}

    def health(self) -> dict:
        return {"status": "closed" if self.closed else "healthy", "uptime": time.time() - self.started, "collections": 0 if self.closed else len(self.names())}

    def backup(self, target: str) -> None:
        """Copy every collection, at the version it has now."""
        for x in self.names():
            c = self.collection(x)
            for held in [*([c.meta.base] if c.meta.base else []), *[f"delta/{d}" for d in c.meta.deltas]]:
                self.files.copy(f"{c.path}/{held}", f"{target}/{x}/{held}")
            self._add(c.meta, target)  # last, so that a backup without it is none

    def restore(self, source: str) -> None:
        """Copy the collections of a backup here; one that exists already is an error."""
        for x in self.files.folders(source):
            if self._versions(x):
                raise AlreadyExists(x)
            self.files.copy(f"{source}/{x}", f"{self.root}/{x}")

    def close(self) -> None:
        self.closed = True
        self.cache.clear()


def content_of(metadata: Column, content: Column, name: str = "_content") -> Column:
    """A row's content: its own column, else the field of its metadata, else empty."""
    return F.coalesce(content, F.get_json_object(metadata, f"$.{name}"), F.lit(""))
