"""Reversible line dedup: exact reference counts behind sharded cuckoo filters.

The state lies in the shared folder as append-only Parquet:

* ``postings``: the distinct line keys of every document, one row a document;
* ``counts``: the exact reference-count table, one row per key and mutation that
  touched it, with the absolute count and smallest holder after that mutation
  (the row with the highest version counts);
* ``filters``: one cuckoo filter per shard of the keys, newest version counts.

A batch's keys go to their shard's filter first. What the filter has never seen
is new for certain and is appended without reading the count table; only the
rest is looked up there, exactly. Deleting a document lowers its keys' counts,
takes keys without holders out of the filters and finds the next smallest
holders, so inserting and deleting a document leaves every decision as it was.

A line's key is the line with ASCII white space stripped at both ends and A-Z
lower-cased; shards and counts hold its 128-bit digest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commentarium.llm.common import bounded_batches, grouped, mixed, plain, runs, texts_of
from commentarium.operators.joins import join_on_content
from commentarium.operators.storage import scratch_path

MIN_KEY_CHARS = 10
SHARDS = 64
BATCH_BYTES = 1 << 20  # of text that a task holds in Arrow at once
_STRIP = b" \t\n\x0b\x0c\r"


def line_key(line: bytes) -> bytes | None:
    """The digest of a line's key; None for keys of fewer than ten code points."""
    key = line.strip(_STRIP).lower()
    if len(key) < MIN_KEY_CHARS or (len(key) < 4 * MIN_KEY_CHARS and len(key.decode("utf-8", "replace")) < MIN_KEY_CHARS):
        return None
    return xxhash.xxh3_128_digest(key)


class CuckooFilter:
    """A set of 64-bit hashes with deletion: 16-bit fingerprints, four to a bucket.

    It grows by whole segments, each filled to 0.8 at most, so an insertion never
    fails. ``add`` must not be told the same hash twice without ``remove``.
    """

    SLOTS, LOAD, KICKS = 4, 0.8, 500

    def __init__(self, segments: list[np.ndarray] | None = None):
        self.segments = segments or []

    @classmethod
    def load(cls, blob: bytes | None) -> CuckooFilter:
        if not blob:
            return cls()
        count = int.from_bytes(blob[:4], "little")
        sizes = np.frombuffer(blob[4 : 4 + 4 * count], dtype=np.uint32)
        cells = np.frombuffer(blob[4 + 4 * count :], dtype=np.uint16)
        ends = np.cumsum(sizes.astype(np.int64) * cls.SLOTS)
        return cls([c.reshape(-1, cls.SLOTS).copy() for c in np.split(cells, ends[:-1])])

    def dump(self) -> bytes:
        sizes = np.array([len(s) for s in self.segments], dtype=np.uint32)
        return len(sizes).to_bytes(4, "little") + sizes.tobytes() + b"".join(s.tobytes() for s in self.segments)

    @staticmethod
    def _places(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprint (never 0) and both buckets; ``buckets`` is a power of two."""
        prints = (hashes & np.uint64(0xFFFF)).astype(np.uint16)
        prints[prints == 0] = 1
        first = ((hashes >> np.uint64(16)) & np.uint64(buckets - 1)).astype(np.int64)
        return prints, first, first ^ CuckooFilter._step(prints, buckets)

    @staticmethod
    def _step(prints: np.ndarray, buckets: int) -> np.ndarray:
        return (mixed(prints.astype(np.uint64)) & np.uint64(buckets - 1)).astype(np.int64)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        found = np.zeros(len(hashes), dtype=bool)
        for s in self.segments:
            prints, first, second = self._places(hashes, len(s))
            found |= (s[first] == prints[:, None]).any(axis=1) | (s[second] == prints[:, None]).any(axis=1)
        return found

    def add(self, hashes: np.ndarray) -> None:
        if not len(hashes):
            return
        if self.segments:
            s = self.segments[-1]
            room = max(0, int(s.size * self.LOAD) - int(np.count_nonzero(s)))
            left = self._fill(s, hashes[:room])
            hashes = np.concatenate([left, hashes[room:]])
        while len(hashes):
            buckets = 1 << max(4, int(np.ceil(np.log2(len(hashes) / (self.SLOTS * self.LOAD)))))
            s = np.zeros((buckets, self.SLOTS), dtype=np.uint16)
            self.segments.append(s)
            hashes = self._fill(s, hashes)

    def _fill(self, s: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Place hashes in a segment, all at once where slots are free, else by kicks; the unplaced come back."""
        prints, first, second = self._places(hashes, len(s))
        waiting = np.arange(len(hashes))
        for at in (first, second):
            for slot in range(self.SLOTS):
                if not len(waiting):
                    break
                want = at[waiting]
                free = s[want, slot] == 0
                _, lead = np.unique(np.where(free, want, -1), return_index=True)
                lead = lead[free[lead]]
                s[want[lead], slot] = prints[waiting[lead]]
                waiting = np.delete(waiting, lead)
        unplaced = []
        for i in waiting.tolist():
            trail, bucket, mark = [], int(second[i]), prints[i]
            for kick in range(self.KICKS):
                empty = np.flatnonzero(s[bucket] == 0)
                if len(empty):
                    s[bucket, empty[0]] = mark
                    break
                slot = kick % self.SLOTS
                trail.append((bucket, slot, s[bucket, slot]))
                s[bucket, slot], mark = mark, s[bucket, slot]
                bucket ^= int(self._step(np.array([mark], dtype=np.uint16), len(s))[0])
            else:
                for b, k, old in reversed(trail):
                    s[b, k] = old
                unplaced.append(i)
        return hashes[unplaced]

    def remove(self, hashes: np.ndarray) -> None:
        """Take out hashes that were added: one matching fingerprint each.

        Where several segments match, it cannot be told whose fingerprint is whose,
        and none is taken out: a stale one costs a look-up, a lost one an answer.
        """
        for h in hashes:
            one = np.array([h], dtype=np.uint64)
            hits = []
            for s in self.segments:
                prints, first, second = self._places(one, len(s))
                for bucket in (first[0], second[0]):
                    slots = np.flatnonzero(s[bucket] == prints[0])
                    if len(slots):
                        hits.append((s, bucket, slots[0]))
                        break
            if len(hits) == 1:
                s, bucket, slot = hits[0]
                s[bucket, slot] = 0


_PROBED = pa.schema(
    [("shard", pa.int32()), ("key", pa.binary()), ("docs", pa.int64()), ("first_doc", pa.int64()),
     ("seen", pa.bool_()), ("blob", pa.binary())]
)


def _filter_hash(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(d[:8] for d in digests), dtype=np.uint64)


class LineIndex:
    """The state of one deduplicated collection; see the module's text.

    ``id_column`` must be a long or int. Rows without an id are never indexed and
    keep all their lines; rows that repeat an id are one document; a null or empty
    text is one empty line; a document already present is not inserted again, so a
    repeated call is harmless.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, shards: int = SHARDS):
        self.spark, self.shards = spark, shards
        self.root = root or scratch_path(spark, "lines")
        self.version = 0
        bounded_batches(spark, size=BATCH_BYTES)

    # Tables ---------------------------------------------------------------

    _SCHEMAS = {
        "postings": "doc_id bigint, keys array<binary>",
        "counts": "shard int, key binary, docs bigint, first_doc bigint, version int",
        "filters": "shard int, blob binary, version int",
    }

    def _read(self, name: str) -> DataFrame:
        if name not in self._kept:
            return self.spark.createDataFrame([], self._SCHEMAS[name])
        return self.spark.read.schema(self._SCHEMAS[name]).parquet(*self._kept[name])

    def _append(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{name}/v{self.version}-{len(self._kept.get(name, []))}"
        df.write.mode("overwrite").parquet(path)
        self._kept.setdefault(name, []).append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    @property
    def _kept(self) -> dict[str, list[str]]:
        return self.__dict__.setdefault("_paths", {})

    def counts(self) -> DataFrame:
        """(shard, key, docs, first_doc): the reference counts as they are now."""
        if self.version == 1:  # one mutation: every key has one row
            return self._read("counts").drop("version")
        newest = (
            self._read("counts")
            .groupBy("shard", "key")
            .agg(F.max(F.struct("version", "docs", "first_doc")).alias("s"))
            .select("shard", "key", "s.docs", "s.first_doc")
        )
        return newest.where("docs > 0")

    def _filters(self) -> DataFrame:
        if self.version <= 1:
            return self._read("filters").drop("version")
        return self._read("filters").groupBy("shard").agg(F.max_by("blob", "version").alias("blob"))

    def _postings(self) -> DataFrame:
        return self._read("postings")

    def _shard(self):
        return F.pmod(F.xxhash64("key"), F.lit(self.shards)).cast("int")

    # Mutations --------------------------------------------------------------

    def keys_of(self, docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
        """(doc_id, keys): the distinct keys of every row's lines."""

        def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [
                    list(dict.fromkeys(k for k in map(line_key, t.split(b"\n")) if k is not None))
                    for t in texts_of(batch.column("text"))
                ]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(found, pa.list_(pa.binary()))], ["doc_id", "keys"]
                )

        given = plain(docs, doc_id=id_column, text=text_column).where("doc_id IS NOT NULL")
        return given.withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(keys, self._SCHEMAS["postings"])

    def insert(self, docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> None:
        """Add a batch of documents: postings, counts and filters."""
        new = self.keys_of(docs, id_column, text_column)
        if self.version:
            new = new.join(self._postings().select("doc_id"), "doc_id", "left_anti")
        self.version += 1
        new = self._append("postings", new)
        holders = new.select("doc_id", F.explode("keys").alias("key"))
        if new.groupBy("doc_id").count().where("count > 1").limit(1).count():  # an id on several rows counts once
            holders = holders.distinct()
        batch = holders.groupBy("key").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first_doc"))
        batch = batch.withColumn("shard", self._shard())
        self._absorb(batch)

    def _absorb(self, batch: DataFrame) -> None:
        """Send a batch's keys through their shards' filters, then count them exactly."""
        old = self._filters()
        version = self.version
        rows = batch.select("shard", F.lit(1).alias("part"), "key", "docs", "first_doc", F.lit(None).cast("binary").alias("blob"))
        if version > 1:
            rows = rows.unionByName(
                old.select("shard", F.lit(0).alias("part"), F.lit(None).cast("binary").alias("key"),
                           F.lit(None).cast("long").alias("docs"), F.lit(None).cast("long").alias("first_doc"), "blob")
            )

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for shard in runs(batches, "shard"):
                keys = shard.filter(pc.is_valid(shard["key"]))
                blobs = shard.filter(pc.is_valid(shard["blob"]))["blob"].to_pylist()
                cuckoo = CuckooFilter.load(blobs[0] if blobs else None)
                hashes = _filter_hash(keys["key"].to_pylist())
                seen = cuckoo.has(hashes)
                cuckoo.add(hashes[~seen])
                count = len(keys)
                columns = [keys[c].combine_chunks() for c in ("shard", "key", "docs", "first_doc")]
                rows = [*columns, pa.array(seen), pa.nulls(count, pa.binary())]
                yield from pa.Table.from_arrays(rows, schema=_PROBED).to_batches()
                row = {"shard": shard["shard"][0].as_py(), "blob": cuckoo.dump()}
                yield pa.RecordBatch.from_pylist([row], schema=_PROBED)

        probed = self._append(
            "probed",
            rows.repartition("shard").sortWithinPartitions("shard", "part", "key")
            .mapInArrow(probe, "shard int, key binary, docs bigint, first_doc bigint, seen boolean, blob binary"),
        )
        stamp = F.lit(version).alias("version")
        fresh = probed.where("key IS NOT NULL AND NOT seen").select("shard", "key", "docs", "first_doc", stamp)
        known = probed.where("key IS NOT NULL AND seen").select("shard", "key", "docs", "first_doc")
        if version > 1:
            # Only keys that the filters may have seen are looked up in the exact table. A false positive
            # is not in it: it is new, and its fingerprint is in the filter already, by another key; add it again.
            before = self._read("counts").join(known.select("key"), "key", "left_semi").groupBy("key").agg(
                F.max(F.struct("version", "docs", "first_doc")).alias("s")
            )
            merged = known.join(before, "key", "left").select(
                "shard",
                "key",
                (F.col("docs") + F.coalesce("s.docs", F.lit(0))).alias("docs"),
                F.least("first_doc", F.when(F.col("s.docs") > 0, F.col("s.first_doc"))).alias("first_doc"),
                stamp,
                (F.coalesce("s.docs", F.lit(0)) == 0).alias("missed"),
            )
            merged = self._append("merged", merged)
            fresh = fresh.unionByName(merged.drop("missed"))
            missed = merged.where("missed").select("shard", "key")
        else:
            # Within one batch keys differ, so a key seen here shared a fingerprint with another of the batch.
            fresh, missed = fresh.unionByName(known.withColumn("version", stamp)), None
        self._append("counts", fresh)
        blobs = probed.where("blob IS NOT NULL").select("shard", "blob")
        self._append("filters", (blobs if missed is None else self._changed(blobs, missed, add=True)).withColumn("version", stamp))

    def _changed(self, blobs: DataFrame, keys: DataFrame, add: bool) -> DataFrame:
        """The filters after adding or removing ``keys(shard, key)``."""

        def change(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for shard in runs(batches, "shard"):
                known = [k for k in shard["key"].to_pylist() if k is not None]
                blob = next((b for b in shard["blob"].to_pylist() if b is not None), None)
                cuckoo = CuckooFilter.load(blob)
                (cuckoo.add if add else cuckoo.remove)(_filter_hash(known))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard["shard"][0].as_py()], pa.int32()), pa.array([cuckoo.dump()], pa.binary())], ["shard", "blob"]
                )

        rows = blobs.select("shard", F.lit(None).cast("binary").alias("key"), "blob").unionByName(
            keys.select("shard", "key", F.lit(None).cast("binary").alias("blob"))
        )
        return grouped(rows, "shard").mapInArrow(change, "shard int, blob binary")

    def delete(self, ids: DataFrame, id_column: str = "doc_id") -> None:
        """Take documents out again; ids that are not in the index change nothing."""
        if not self.version:
            return
        gone_ids = plain(ids, doc_id=id_column).where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long")).distinct()
        postings = self._postings()
        gone = postings.join(gone_ids, "doc_id", "left_semi")
        stay = postings.join(gone_ids, "doc_id", "left_anti")
        before = self.counts()
        self.version += 1
        lost = self._append(
            "lost",
            gone.select("doc_id", F.explode("keys").alias("key")).distinct().groupBy("key").agg(
                F.count("*").alias("lost"), F.min("doc_id").alias("lost_first")
            ),
        )
        touched = before.join(lost, "key")
        # Only keys that lose their smallest holder and have another need the postings.
        orphans = touched.where("docs > lost AND lost_first = first_doc").select("key")
        heirs = (
            stay.select("doc_id", F.explode("keys").alias("key"))
            .join(orphans, "key", "left_semi")
            .groupBy("key")
            .agg(F.min("doc_id").alias("heir"))
        )
        after = touched.join(heirs, "key", "left").select(
            "shard", "key", (F.col("docs") - F.col("lost")).alias("docs"),
            F.coalesce("heir", "first_doc").alias("first_doc"), F.lit(self.version).alias("version"),
        )
        filters = self._filters()
        stay = self._append("stay", stay)
        after = self._append("counts", after)
        self._kept["postings"] = [self._kept["stay"][-1]]
        changed = self._changed(filters, after.where("docs = 0").select("shard", "key"), add=False)
        self._append("filters", changed.withColumn("version", F.lit(self.version)))

    # Decisions --------------------------------------------------------------

    def dropped_keys(self) -> DataFrame:
        """(doc_id, keys): the keys whose lines each document loses; documents that lose none are absent.

        Hot keys are salted; a document's list is no longer than the document.
        """
        shared = self.counts().where("docs >= 2").select("key", "first_doc", "docs")
        holders = self._postings().select("doc_id", F.explode("keys").alias("key"))
        lost = join_on_content(holders, shared, "key", "docs", spread_by="doc_id", how="inner").where("doc_id <> first_doc")
        return lost.groupBy("doc_id").agg(F.collect_set("key").alias("keys"))

    def kept(self, docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
        """``docs`` with ``n_lines``, ``n_dropped`` and ``kept_text``; own columns stay, but for those three names."""
        own = [c for c in docs.columns if c not in ("n_lines", "n_dropped", "kept_text")]
        packed = docs.select(
            F.col(f"`{id_column}`").cast("long").alias("_id"), F.struct(*[docs[f"`{c}`"] for c in own]).alias("_row")
        )
        rows = packed.join(self.dropped_keys().withColumnRenamed("doc_id", "_id"), "_id", "left")

        @F.pandas_udf("n_dropped bigint, kept_text string")
        def keep(texts, lists):
            import pandas as pd

            out = []
            for text, keys in zip(texts, lists, strict=True):
                if keys is None:
                    out.append((0, None))
                    continue
                lines = (text or "").split("\n")
                gone = frozenset(map(bytes, keys))
                stay = [x for x in lines if line_key(x.encode("utf-8")) not in gone]
                out.append((len(lines) - len(stay), "\n".join(stay)))
            return pd.DataFrame(out, columns=["n_dropped", "kept_text"])

        # Only texts that lose lines go to Python; the others stay where they are.
        text, loses = F.coalesce(F.col(f"_row.`{text_column}`"), F.lit("")), F.col("keys").isNotNull()
        done = rows.select("_row", loses.alias("_loses"), keep(F.when(loses, text), "keys").alias("_k"))
        return done.select(
            "_row.*",
            F.size(F.split(text, "\n")).cast("long").alias("n_lines"),
            "_k.n_dropped",
            F.when(F.col("_loses"), F.col("_k.kept_text")).otherwise(text).alias("kept_text"),
        )


def deduplicate_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One pass: index every document, then keep each repeated line in its smallest document only."""
    index = LineIndex(docs.sparkSession, shards=shards_for(docs))
    index.insert(docs, id_column, text_column)
    return index.kept(docs, id_column, text_column)


def shards_for(docs: DataFrame, docs_per_shard: int = 5_000) -> int:
    """Filters of about the same size whatever the number of documents (a Parquet count reads footers only)."""
    return max(8, docs.count() // docs_per_shard)
