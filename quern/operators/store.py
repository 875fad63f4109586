"""Index versions as Parquet: immutable segments, and a pointer to the segments of each version.

A full build is one segment.  A change (upsert, delete, a batch of a stream) adds a segment of its own size: its
rows and postings, the keys of older rows that it replaces, and what it adds to or takes from document frequencies
and vocabulary.  Reading takes the rows of all segments without those that a later one replaced, and the sums of the
rest.  After ``max_segments`` changes a version is written whole again.

A version is a file that appears by one rename under a name of its own (``CURRENT-<number>``); readers take the
highest, so they see all of a version or none.  Writers of a model exclude each other by a lock file.  Segments of the
last two versions stay for readers that still use them.
"""

from __future__ import annotations

import json
import time
import uuid
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import analysis
from quern.operators import blocks
from quern.operators.index import Index, postings, pruned, rows, vocabulary_trigrams, with_lengths, words_of
from quern.sources import io
from quern.spec import Config, SearchableSpec

#: Replaced keys that are broadcast to the rows of older segments; more are joined by shuffles.
BROADCAST_KEYS = 1_000_000
#: Times its share of the cores that a partition may hold before records are dealt out again.
SKEW = 2
#: Texts and tokens of an index are large and alike.
COMPRESSION = "zstd"


def spread(records: DataFrame, key: str) -> DataFrame:
    """The records spread over the cores: one small file, or a large one of one row group, would be one task."""
    n = records.sparkSession.sparkContext.defaultParallelism
    parts = records._jdf.rdd().getNumPartitions()
    if parts >= n:
        # a file is divided by its bytes, but read by its row groups: partitions may be empty
        sizes = [r[0] for r in records.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).select("n").collect()]
        if max(sizes, default=0) * n <= SKEW * sum(sizes):
            return records
    return records.repartition(max(n, parts), F.col(f"`{key}`"))


def one_a_key(records: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """The records with one row a key: the last by ``order``, and of equals the one with the highest hash.

    Only if keys repeat are whole records shuffled; rows without a key are left as they are.
    """
    k = F.col(f"`{key}`")
    if records.where(k.isNotNull()).groupBy(k.alias("k")).count().where("count > 1").isEmpty():
        return records
    every = F.struct(*[F.col(f"`{c}`") for c in records.columns])
    place = F.struct(*([F.col(f"`{order}`")] if order else []), F.xxhash64(F.to_json(every)))
    last = records.where(k.isNotNull()).groupBy(k.alias("__k")).agg(F.max_by(every, place).alias("__r"))
    return last.select(*[F.col(f"__r.`{c}`").alias(c) for c in records.columns]).unionByName(records.where(k.isNull()))


class IndexStore:
    """Indexes by tenant and model under one folder."""

    def __init__(self, spark: SparkSession, root: str, config: Config = Config(), max_segments: int = 8):
        self.spark, self.root, self.config, self.max_segments = spark, root.rstrip("/"), config, max_segments

    # --- files -------------------------------------------------------------------------------------------------

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def folder(self, tenant: str, model: str) -> str:
        if not tenant or not model or any(c in "/\\" or ord(c) < 32 for c in tenant + model) or ".." in (tenant, model):
            raise ValueError("tenant and model are names without slashes")
        return f"{self.root}/tenant={tenant}/model={model}"

    def _names(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def versions(self, tenant: str, model: str) -> list[int]:
        names = self._names(self.folder(tenant, model))
        return sorted(int(n[len("CURRENT-") :]) for n in names if n.startswith("CURRENT-"))

    def _meta(self, tenant: str, model: str, version: int) -> dict:
        fs, p = self._fs(f"{self.folder(tenant, model)}/CURRENT-{version}")
        stream = fs.open(p)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def meta(self, tenant: str, model: str) -> dict | None:
        """What the current version is made of; None if there is none."""
        known = self.versions(tenant, model)
        return self._meta(tenant, model, known[-1]) if known else None

    def _put(self, path: str, content: str, overwrite: bool) -> None:
        fs, p = self._fs(path)
        out = fs.create(p, overwrite)
        out.write(bytearray(content.encode()))
        out.close()

    def _point(self, tenant: str, model: str, meta: dict) -> None:
        base = self.folder(tenant, model)
        fresh = f"{base}/_new-{uuid.uuid4().hex}"
        self._put(fresh, json.dumps(meta), True)
        fs, p = self._fs(fresh)
        if not fs.rename(p, self._fs(f"{base}/CURRENT-{meta['version']}")[1]):
            raise RuntimeError(f"version {meta['version']} of {model} was written by another writer")

    @contextmanager
    def _locked(self, tenant: str, model: str):
        path = f"{self.folder(tenant, model)}/LOCK"
        try:
            self._put(path, str(time.time()), False)
        except Exception as e:
            if "FileAlreadyExists" in str(e) or "already exists" in str(e).lower():
                raise RuntimeError(f"{model} is being written; if its writer is gone, call unlock") from None
            raise
        try:
            yield
        finally:
            self.unlock(tenant, model)

    def unlock(self, tenant: str, model: str) -> None:
        """Takes the lock off a model whose writer is gone; the version before it stands."""
        fs, p = self._fs(f"{self.folder(tenant, model)}/LOCK")
        fs.delete(p, False)

    # --- reading -----------------------------------------------------------------------------------------------

    def exists(self, tenant: str, model: str) -> bool:
        return bool(self.versions(tenant, model))

    def models(self, tenant: str) -> list[str]:
        found = [n[len("model=") :] for n in self._names(f"{self.root}/tenant={tenant}") if n.startswith("model=")]
        return sorted(n for n in found if self.exists(tenant, n))

    def load(self, spec: SearchableSpec, tenant: str = "default", source: DataFrame | None = None, config: Config | None = None) -> Index:
        """The current version; config: other settings for queries than those of the store."""
        meta = self.meta(tenant, spec.model)
        if meta is None:
            raise LookupError(f"no index of {spec.model} for tenant {tenant}")
        return self._index(meta, spec, tenant, source, config or self.config)

    def _index(self, meta: dict, spec: SearchableSpec, tenant: str, source: DataFrame | None, config: Config) -> Index:
        base = self.folder(tenant, spec.model)
        segments = meta["segments"]
        paths = lambda name, some: [f"{base}/segments/{s['seg']}/{name}" for s in some]
        read = lambda name: self.spark.read.parquet(*paths(name, segments))
        tables = {name: read(name) for name in ("index", "postings", "term_df", "vocab", "vocab_tri")}
        tables["postings"] = tables["postings"].withColumns({"tenant": F.lit(tenant), "model": F.lit(spec.model)})
        dead = [s for s in segments if s["dead"]]
        if dead:
            gone = self.spark.read.parquet(*paths("dead", dead)).toDF("__id", "__seg")
            gone = F.broadcast(gone) if sum(s["dead"] for s in dead) <= BROADCAST_KEYS else gone
            for name in ("index", "postings"):
                t = tables[name]
                tables[name] = t.join(gone, (t["doc_id"] == F.col("__id")) & (t["seg"] < F.col("__seg")), "left_anti")
        if len(segments) > 1:
            added = lambda t, by, n: tables[t].groupBy(*by).agg(F.sum(n).alias(n)).where(F.col(n) > 0)
            tables["term_df"] = added("term_df", ["tenant", "model", "term"], "df")
            tables["vocab"] = added("vocab", ["tenant", "word", "ascii_word"], "doc_count")
            tables["vocab_tri"] = added("vocab_tri", ["tenant", "trigram", "word", "ascii_word"], "doc_count")
        count, length = meta["doc_count"], meta["total_length"]
        stats = self.spark.createDataFrame([(tenant, spec.model, count, length / count if count else 0.0)], "tenant string, model string, doc_count long, avg_len double")
        frame = tables.pop("index").drop("seg")
        return Index(frame, spec, config, tenant, source, {**tables, "postings": tables["postings"].drop("seg"), "stats": stats}, (count, length / count if count else 0.0), meta["version"])

    # --- writing -----------------------------------------------------------------------------------------------

    def _segment(self, base: str, seg: int, fresh: DataFrame, spec: SearchableSpec, tenant: str, removed: DataFrame | None) -> tuple[int, int, int]:
        """Writes a segment; the change of documents and of tokens, and the keys that it replaces."""
        at = f"{base}/segments/{seg}"
        fresh.withColumn("seg", F.lit(seg)).write.mode("overwrite").option("compression", COMPRESSION).parquet(f"{at}/index")
        made = self.spark.read.parquet(f"{at}/index")
        lengths = [F.coalesce(F.col(f"len_w{w}"), F.lit(0)) for w in range(1, self.config.max_weight + 1)]
        total = F.sum(sum(lengths[1:], lengths[0]))

        # what all rows of a segment share isn't shuffled with them
        fixed = {"tenant": F.lit(tenant), "model": F.lit(spec.model), "seg": F.lit(seg)}

        def put(frame: DataFrame, name: str, *shared: str) -> DataFrame:
            frame.withColumns({k: fixed[k] for k in shared}).write.mode("overwrite").option("compression", COMPRESSION).parquet(f"{at}/{name}")
            return self.spark.read.parquet(f"{at}/{name}")

        def write(frame: DataFrame, name: str, by: str, *shared: str) -> DataFrame:
            return put(frame.repartitionByRange(by).sortWithinPartitions(by), name, *shared)

        def terms() -> None:
            keyed = made.where(F.col("doc_id").isNotNull())
            parts = [blocks.sorted_postings(keyed, range(1, self.config.max_weight + 1), blocks.ranges(keyed, words_of(self.config), length))]
            if keyless:  # they share a key, so that their postings are those of one document
                parts.append(postings(made.where(F.col("doc_id").isNull()), self.config))
            own = put(reduce(DataFrame.unionByName, [p.select("term", "doc_id", "w", "tf", "dl") for p in parts]), "postings", "seg")
            buckets = {min(max(c.weight, 1), self.config.max_weight) for c in spec.columns}
            # a document has a row for each of its buckets with the term
            held = own.select("term", "doc_id").distinct() if len(buckets) > 1 else own
            df = held.groupBy("term").agg(F.count("*").alias("df"))
            if removed is not None:
                lost = gone.select(F.explode(F.array_distinct(words_of(self.config))).alias("term"))
                lost = lost.groupBy("term").agg((-F.count("*")).alias("df"))
                df = df.unionByName(lost).groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0")
            words = write(df, "term_df", "term", "tenant", "model").select(F.col("term").alias("word"), F.col("df").alias("doc_count"))
            vocab = write(words.select("word", analysis.transliterate(F.col("word")).alias("ascii_word"), "doc_count"), "vocab", "ascii_word", "tenant")
            grams = vocabulary_trigrams(vocab).drop("tenant").withColumn("ascii_word", F.when(F.col("ascii_word") != F.col("word"), F.col("ascii_word")))
            grams = grams.repartitionByRange("trigram").sortWithinPartitions("trigram")
            put(grams.withColumn("ascii_word", F.coalesce("ascii_word", "word")), "vocab_tri", "tenant")

        row = made.agg(F.count("*"), total, F.count_if(F.col("doc_id").isNull())).first()
        count, length, keyless = int(row[0]), int(row[1] or 0), bool(row[2])
        if removed is not None:
            removed.write.mode("overwrite").parquet(f"{at}/removed")
            gone = self.spark.read.parquet(f"{at}/removed")
            gone.select("doc_id", F.lit(seg).alias("seg")).write.mode("overwrite").parquet(f"{at}/dead")
        terms()
        dead = 0
        if removed is not None:
            row = gone.agg(F.count("*"), total).first()
            dead, count, length = int(row[0]), count - int(row[0]), length - int(row[1] or 0)
            fs, p = self._fs(f"{at}/removed")
            fs.delete(p, True)
        return count, length, dead

    def _commit(self, frame: DataFrame, spec: SearchableSpec, tenant: str, synced_at: str | None, more: dict | None = None) -> int:
        """A version of one segment."""
        before = self.meta(tenant, spec.model) or {"version": 0, "segments": []}
        base = self.folder(tenant, spec.model)
        seg = 1 + max([0, *map(int, self._names(f"{base}/segments"))])
        count, length, _ = self._segment(base, seg, frame, spec, tenant, None)
        meta = {"version": before["version"] + 1, "schema_version": 1, "columns": {c.name: c.weight for c in spec.columns}, "last_synced_at": synced_at}
        meta |= {"segments": [{"seg": seg, "dead": 0}], "doc_count": count, "total_length": length} | (more or {})
        self._point(tenant, spec.model, meta)
        self._vacuum(tenant, spec.model)
        return meta["version"]

    def _change(self, fresh: DataFrame, keys: DataFrame, spec: SearchableSpec, tenant: str, synced_at: str | None) -> int:
        """A version with one more segment: rows that are added, keys whose older rows go."""
        meta = self.meta(tenant, spec.model)
        if meta is None:
            raise LookupError(f"no index of {spec.model} for tenant {tenant}")
        base = self.folder(tenant, spec.model)
        seg = 1 + max([0, *map(int, self._names(f"{base}/segments"))])
        removed = self.load(spec, tenant).rows.join(keys, "doc_id", "left_semi")
        count, length, dead = self._segment(base, seg, fresh, spec, tenant, removed)
        meta |= {"version": meta["version"] + 1, "last_synced_at": synced_at or meta["last_synced_at"], "doc_count": meta["doc_count"] + count, "total_length": meta["total_length"] + length}
        meta["segments"] = [*meta["segments"], {"seg": seg, "dead": dead}]
        meta.pop("fingerprint", None)
        self._point(tenant, spec.model, meta)
        if len(meta["segments"]) > self.max_segments:
            return self._commit(self.load(spec, tenant).rows, spec, tenant, meta["last_synced_at"])
        self._vacuum(tenant, spec.model)
        return meta["version"]

    def _vacuum(self, tenant: str, model: str, versions: int = 2) -> None:
        """Deletes what the last versions don't use: older pointers, segments, files of writers that stopped midway."""
        base = self.folder(tenant, model)
        known = self.versions(tenant, model)
        used = {str(s["seg"]) for v in known[-versions:] for s in self._meta(tenant, model, v)["segments"]}
        old = [f"CURRENT-{v}" for v in known[:-versions]] + [n for n in self._names(base) if n.startswith("_new-")]
        old += [f"segments/{n}" for n in self._names(f"{base}/segments") if n not in used]
        for name in old:
            fs, p = self._fs(f"{base}/{name}")
            fs.delete(p, True)

    def write(self, frame: DataFrame, spec: SearchableSpec, tenant: str = "default", synced_at: str | None = None) -> int:
        """A new version of a model's index from index rows, which become this tenant's; its number."""
        own = frame.withColumns({"tenant": F.lit(tenant), "model": F.lit(spec.model)})
        with self._locked(tenant, spec.model):
            return self._commit(own if "len_w1" in own.columns else with_lengths(own, self.config), spec, tenant, synced_at)

    def rebuild(self, records: DataFrame, spec: SearchableSpec, tenant: str = "default", synced_at: str | None = None, unless_same: bool = False, order: str | None = None) -> int:
        """The index of all records, one a key; with ``unless_same`` nothing is written if they are as they were."""
        at = F.lit(synced_at).cast("timestamp") if synced_at else F.current_timestamp()
        with self._locked(tenant, spec.model):
            own = one_a_key(records, spec.key, order)
            more = {}
            if unless_same:
                more = {"fingerprint": fingerprint(own, spec)}
                now = self.meta(tenant, spec.model)
                if now and now.get("fingerprint") == more["fingerprint"] and now["columns"] == {c.name: c.weight for c in spec.columns}:
                    return now["version"]
            return self._commit(rows(spread(own, spec.key), spec, self.config, tenant, at), spec, tenant, synced_at, more)

    def upsert(self, records: DataFrame, spec: SearchableSpec, tenant: str = "default", synced_at: str | None = None, order: str | None = None) -> int:
        """The index with these records added or replaced, one a key; those that shouldn't be indexed any more are removed."""
        at = F.lit(synced_at).cast("timestamp") if synced_at else F.current_timestamp()
        with self._locked(tenant, spec.model):
            keys = records.select(F.col(f"`{spec.key}`").cast("string").alias("doc_id")).distinct()
            return self._change(rows(one_a_key(records, spec.key, order), spec, self.config, tenant, at), keys, spec, tenant, synced_at)

    def sync_since(self, records: DataFrame, spec: SearchableSpec, changed: str, synced_at: str, since: str | None = None, tenant: str = "default") -> int:
        """The index with the records whose column ``changed`` is at or after ``since`` (the last synchronisation)."""
        since = since or (self.meta(tenant, spec.model) or {}).get("last_synced_at")
        if not self.exists(tenant, spec.model) or since is None:
            return self.rebuild(records, spec, tenant, synced_at, order=changed)
        return self.upsert(io.since(records, changed, since), spec, tenant, synced_at, order=changed)

    def delete(self, keys: DataFrame, spec: SearchableSpec, tenant: str = "default", synced_at: str | None = None) -> int:
        """The index without the records whose keys are in the one column of keys."""
        gone = keys.select(keys[keys.columns[0]].cast("string").alias("doc_id")).distinct()
        with self._locked(tenant, spec.model):
            return self._change(self._none(spec, tenant), gone, spec, tenant, synced_at)

    def _none(self, spec: SearchableSpec, tenant: str) -> DataFrame:
        return self.load(spec, tenant).rows.limit(0)

    def merge(self, fresh: DataFrame, keys: DataFrame, spec: SearchableSpec, tenant: str = "default", synced_at: str | None = None) -> int:
        """The index with index rows added and the older rows of keys (doc_id) gone."""
        with self._locked(tenant, spec.model):
            return self._change(fresh, keys, spec, tenant, synced_at)

    def prune(self, spec: SearchableSpec, tenant: str = "default", keep: int | None = None) -> int:
        keep = self.config.max_documents if keep is None else keep
        with self._locked(tenant, spec.model):
            meta = self.meta(tenant, spec.model) or {}
            if keep <= 0 or meta.get("doc_count", keep + 1) <= keep:
                return meta["version"]
            return self._commit(pruned(self.load(spec, tenant).rows, keep), spec, tenant, meta.get("last_synced_at"))

    def optimize(self, spec: SearchableSpec, tenant: str = "default", files: int | None = None) -> int:
        """The same rows as one segment; ``files``: in so many files, by key."""
        current = self.load(spec, tenant).rows
        with self._locked(tenant, spec.model):
            frame = current.repartition(files, "doc_id") if files else current
            return self._commit(frame, spec, tenant, (self.meta(tenant, spec.model) or {}).get("last_synced_at"))

    def drop(self, tenant: str, model: str) -> None:
        fs, p = self._fs(self.folder(tenant, model))
        fs.delete(p, True)

    # --- checking ----------------------------------------------------------------------------------------------

    def check_schema(self, specs: list[SearchableSpec], tenant: str = "default") -> dict[str, str]:
        """``ok``, ``missing`` or ``drift`` by model."""
        found = {}
        for spec in specs:
            meta = self.meta(tenant, spec.model)
            found[spec.model] = "missing" if meta is None else "ok" if meta["columns"] == {c.name: c.weight for c in spec.columns} else "drift"
        return found

    def orphans(self, specs: list[SearchableSpec], tenant: str = "default") -> list[str]:
        """Indexes of models that aren't in specs."""
        return sorted(set(self.models(tenant)) - {s.model for s in specs})

    def drop_orphans(self, specs: list[SearchableSpec], tenant: str = "default") -> list[str]:
        """Drops the indexes of models that aren't in specs; their names."""
        gone = self.orphans(specs, tenant)
        for model in gone:
            self.drop(tenant, model)
        return gone

    def integrity(self, spec: SearchableSpec, tenant: str = "default") -> list[str]:
        """What is wrong with an index; nothing, if all is well."""
        index, problems = self.load(spec, tenant), []
        total, keys, nulls = integrity_figures(index.rows).first()
        if nulls:
            problems.append(f"{nulls} rows without a key")
        if keys + nulls != total:
            problems.append(f"{total - keys - nulls} repeated keys")
        if index.doc_count != total:
            problems.append(f"statistics say {index.doc_count} documents, there are {total}")
        return problems

    def status(self, tenant: str = "default") -> DataFrame:
        """(model, version, documents, segments, last_synced_at)"""
        found = [(m, self.meta(tenant, m)) for m in self.models(tenant)]
        out = [(m, x["version"], x["doc_count"], len(x["segments"]), x["last_synced_at"]) for m, x in found]
        return self.spark.createDataFrame(out, "model string, version int, documents long, segments int, last_synced_at string")


def integrity_figures(frame: DataFrame) -> DataFrame:
    """One row (row_count, keys, nulls) over index rows."""
    return frame.agg(F.count("*").alias("row_count"), F.countDistinct("doc_id").alias("keys"), F.coalesce(F.sum(F.col("doc_id").isNull().cast("long")), F.lit(0)).alias("nulls"))


def fingerprint(records: DataFrame, spec: SearchableSpec) -> str:
    """A digest of all keys and searchable values, whatever their order; relations by the columns of their own rows."""
    from quern.operators.index import document

    row = document(records, spec)
    h: Column = F.xxhash64(*[F.col(f"`{c}`") for c in row.columns])
    n, total, mix = row.agg(F.count("*"), F.sum(h.cast("decimal(38,0)")), F.bit_xor(h)).first()
    return f"{n}:{total}:{mix}"
