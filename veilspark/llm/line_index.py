"""Line dedup that can be undone: exact reference counts of lines, and sharded cuckoo filters in front of them.

A line's key is the line without white space at its ends and with A-Z in lower case. Keys of at least ten code points that several
documents hold lose their lines except in the document with the smallest id. An index in the shared folder holds

* `postings`: (key, doc_id) of every inserted document,
* `counts`: for a key, the exact number of documents that hold it and the smallest of them,
* `filters`: per shard of the keys, a cuckoo filter of the keys in the index (`present`) and one of those with several documents
  (`repeated`).

Keys are 128-bit hashes. Inserting looks a new batch's keys up in `present`: what is absent there is new for certain and needs
no look at the counts, what is found is compared with them exactly. Deleting documents takes their postings away, counts what their keys have
left, and removes keys from the filters as their count falls below two or one, which is what cuckoo filters can and Bloom
filters can't. So lines come back as the documents before them go. Reading lets the lines through `repeated` before anything is
shuffled: only lines that may be repeated meet the counts. A filter only says "maybe" or "no", so it changes no result; where
all filters together are larger than `FILTER_BYTES`, reading goes without them.

Every change writes a new version of what it touches and names it in `versions` last: a job that dies leaves the version before.
A key that very many documents hold is a row per task after the map-side count, and meets its count by a broadcast of the hot
keys, of which there are at most as many as partitions.

Rows with equal ids are one document as to what it holds, and a row each in the result. A null id is one document that comes after all others.
Null and empty texts are one empty line. Without documents the index stays empty. Columns of the documents are kept in
a struct, so no name can clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm.common import packed, staged, utf8

#: Code points of the shortest key that counts, and the white space that a key lacks at its ends.
SHORTEST, SPACE = 10, b" \t\n\v\f\r"
#: Keys that a shard has on average when its filters are built; both filters of a shard take about 1 MB then.
SHARD_KEYS = 100_000
#: All `repeated` filters together that a worker may hold.
FILTER_BYTES = 64 << 20
_SLOTS, _KICKS = 4, 500


class CuckooFilter:
    """A set of 64-bit hashes as 16-bit fingerprints, four to a bucket. A fingerprint is in one of two buckets, each found from the other."""

    def __init__(self, buckets: int, table: np.ndarray | None = None) -> None:
        self.mask = np.uint64(buckets - 1)
        self.table = np.zeros((buckets, _SLOTS), np.uint16) if table is None else table

    @classmethod
    def for_keys(cls, n: int) -> CuckooFilter:
        """Room for `n` keys at a load of at most three quarters."""
        return cls(1 << max(4, (max(n, 1) * 4 // (3 * _SLOTS)).bit_length()))

    @classmethod
    def load(cls, data: bytes) -> CuckooFilter:
        table = np.frombuffer(data, np.uint16).reshape(-1, _SLOTS).copy()
        return cls(len(table), table)

    def dump(self) -> bytes:
        return self.table.tobytes()

    def room(self) -> int:
        """How many more keys it takes up to nine tenths of its slots."""
        return int(0.9 * self.table.size) - int(np.count_nonzero(self.table))

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        prints = (hashes >> np.uint64(48)).astype(np.uint16)
        prints[prints == 0] = 1
        return prints, hashes & self.mask

    def _other(self, bucket: np.ndarray, prints: np.ndarray) -> np.ndarray:
        return (bucket ^ (prints.astype(np.uint64) * np.uint64(0x5BD1E995))) & self.mask

    def __contains__(self, key: int) -> bool:
        return bool(self.find(np.array([key], np.uint64))[0])

    def find(self, hashes: np.ndarray) -> np.ndarray:
        prints, bucket = self._places(hashes)
        found = (self.table[bucket] == prints[:, None]).any(1)
        return found | (self.table[self._other(bucket, prints)] == prints[:, None]).any(1)

    def _settle(self, prints: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Put what fits into free slots of its bucket; returns which fitted."""
        order = np.argsort(bucket, kind="stable")
        sorted_ = bucket[order]
        rank = np.arange(len(order)) - np.searchsorted(sorted_, sorted_)
        free = self.table[sorted_] == 0
        fits = rank < free.sum(1)
        slot = np.argmax(np.cumsum(free[fits], 1) == rank[fits, None] + 1, 1)
        self.table[sorted_[fits], slot] = prints[order[fits]]
        settled = np.zeros(len(order), bool)
        settled[order[fits]] = True
        return settled

    def add(self, hashes: np.ndarray) -> bool:
        """Add distinct keys; False if some found no place (the filter is to be built anew, larger)."""
        prints, bucket = self._places(hashes)
        for kick in range(_KICKS):
            for _ in range(2):
                left = ~self._settle(prints, bucket)
                prints, bucket = prints[left], bucket[left]
                bucket = self._other(bucket, prints)
            if not len(prints):
                return True
            # One of each full bucket takes the place of another, which moves on to its other bucket.
            _, one = np.unique(bucket, return_index=True)
            slot = kick % _SLOTS
            out = self.table[bucket[one], slot].copy()
            self.table[bucket[one], slot] = prints[one]
            prints[one] = out
            bucket[one] = self._other(bucket[one], out)
        return False

    def remove(self, hashes: np.ndarray) -> None:
        """Remove keys that were added."""
        for p, b in zip(*self._places(hashes), strict=True):
            for at in (int(b), int(self._other(np.array([b]), np.array([p]))[0])):
                slots = np.flatnonzero(self.table[at] == p)
                if len(slots):
                    self.table[at, slots[0]] = 0
                    break


def line_keys(text: bytes) -> list[bytes]:
    """The key of each line, as a hash; empty where the line is too short to count."""
    keys = []
    for line in text.split(b"\n"):
        key = line.strip(SPACE).lower()
        short = len(key) < SHORTEST or not key.isascii() and len(key.decode()) < SHORTEST
        keys.append(b"" if short else hashlib.blake2b(key, digest_size=16).digest())
    return keys


def _hashes(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(keys), ">u8")[::2].astype(np.uint64)


def _shard(shards: int) -> Column:
    """The shard of a key: the filters use the first eight bytes of it, the shard others."""
    return F.conv(F.hex(F.substring("key", 13, 4)), 16, 10).cast("long") % shards


def _smallest(doc_id: str = "doc_id") -> Column:
    return F.min(F.struct(F.col(doc_id).isNull().alias("last"), F.col(doc_id).alias("doc_id")))


def _keys_of(docs: DataFrame, filters: list[tuple[int, bytes]] | None = None, shards: int = 1) -> DataFrame:
    """Distinct (key, doc_id) of each row of `docs`; with filters, only of the keys that they may hold."""
    shared = docs.sparkSession.sparkContext.broadcast(filters) if filters is not None else None

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = {shard: CuckooFilter.load(data) for shard, data in shared.value} if shared else {}
        for batch in batches:
            sets = [list(dict.fromkeys(filter(None, line_keys(text)))) for text in utf8(batch.column("text"))]
            rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            keys = [key for s in sets for key in s]
            if shared and keys:
                shard = np.frombuffer(b"".join(keys), ">u4")[3::4].astype(np.int64) % shards
                hashes, maybe = _hashes(keys), np.zeros(len(keys), bool)
                for number in np.unique(shard).tolist():
                    if number in loaded:
                        of = shard == number
                        maybe[of] = loaded[number].find(hashes[of])
                rows, keys = rows[maybe], [key for key, m in zip(keys, maybe.tolist(), strict=True) if m]
            for part in range(0, len(keys), 10_000):
                some = batch.column("doc_id").take(pa.array(rows[part : part + 10_000]))
                yield pa.RecordBatch.from_arrays([pa.array(keys[part : part + 10_000], pa.binary()), some], ["key", "doc_id"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(cut, f"key binary, doc_id {kind}")


_FILTERS = "shard long, present binary, repeated binary, full boolean"


def _filter_row(shard: int, present: CuckooFilter, repeated: CuckooFilter, full: bool) -> pa.Table:
    return pa.table(
        {"shard": pa.array([shard], pa.int64()), "present": [present.dump()], "repeated": [repeated.dump()], "full": [full]}
    )


def _built(changes: pa.Table) -> pa.Table:
    """The filters of one shard from all its keys (shard, key, n)."""
    hashes = _hashes(changes.column("key").to_pylist())
    several = hashes[changes.column("n").to_numpy() > 1]
    for grow in range(8):
        present, repeated = CuckooFilter.for_keys(len(hashes) << grow), CuckooFilter.for_keys(len(several) << grow)
        if present.add(hashes) and repeated.add(several):
            return _filter_row(changes.column("shard")[0].as_py(), present, repeated, False)
    raise RuntimeError("a shard's keys share too many fingerprints")


def _changed(changes: pa.Table, old: pa.Table) -> pa.Table:
    """The filters of one shard after its keys went from `was` to `n` documents; `full` if they have no room for them."""
    shard = (changes if len(changes) else old).column("shard")[0].as_py()
    present, repeated = (CuckooFilter.load(old.column(c)[0].as_py()) if len(old) else CuckooFilter.for_keys(SHARD_KEYS) for c in ("present", "repeated"))
    hashes = _hashes(changes.column("key").to_pylist())
    was, now = changes.column("was").to_numpy(), changes.column("n").to_numpy()
    full = False
    for chosen, least in ((present, 1), (repeated, 2)):
        chosen.remove(hashes[(was >= least) & (now < least)])
        more = hashes[(was < least) & (now >= least)]
        full |= len(more) > chosen.room() or not chosen.add(more)
    return _filter_row(shard, present, repeated, bool(full))


def _probed(keys: pa.Table, filters: pa.Table) -> pa.Table:
    """Which of a shard's keys its `present` filter may hold."""
    found = np.zeros(len(keys), bool)
    if len(filters) and len(keys):
        found = CuckooFilter.load(filters.column("present")[0].as_py()).find(_hashes(keys.column("key").to_pylist()))
    return keys.append_column("maybe", pa.array(found))


class LineIndex:
    """The lines of a set of documents, in a folder that all executors share. One writer at a time."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        """Open the index that `create` made in `folder`."""
        self.spark, self.folder = spark, folder
        last = self._table("versions", "version long, shards long, built long, id_type string").orderBy(F.desc("version")).first()
        self.version, self.shards, self.built, self.id_type = last[:4]

    @classmethod
    def create(cls, spark: SparkSession, folder: str, id_type: str = "bigint") -> LineIndex:
        """A new index without documents."""
        folder = folder.rstrip("/")
        spark.createDataFrame([], f"doc_id {id_type}").write.parquet(f"{folder}/removed/v=0")
        spark.createDataFrame([(0, 0, 0, id_type)], "version long, shards long, built long, id_type string").coalesce(1).write.parquet(f"{folder}/versions/v=0")
        return cls(spark, folder)

    def _table(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(f"{schema}, v long").parquet(f"{self.folder}/{name}")

    def _read(self, name: str, schema: str) -> DataFrame:
        return self._table(name, schema).where(F.col("v") <= self.version)

    def _write(self, df: DataFrame, name: str, version: int) -> DataFrame:
        """Write `df` as `version` of a table, over what a dead job may have left of it, and read it back."""
        path = f"{self.folder}/{name}/v={version}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _commit(self, version: int, shards: int, built: int) -> None:
        row = self.spark.createDataFrame([(version, shards, built, self.id_type)], "version long, shards long, built long, id_type string")
        self._write(row.coalesce(1), "versions", version)
        self.version, self.shards, self.built = version, shards, built

    def postings(self) -> DataFrame:
        """(key, doc_id) of the documents in the index."""
        gone = self._read("removed", f"doc_id {self.id_type}").groupBy(F.col("doc_id").alias("gone")).agg(F.max("v").alias("until"))
        rows = self._read("postings", f"key binary, doc_id {self.id_type}")
        live = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("gone")) & (F.col("v") <= F.col("until")), "left_anti")
        return live.select("key", "doc_id")

    def _counts(self, version: int) -> DataFrame:
        rows = self._table("counts", f"key binary, n long, first struct<last:boolean,doc_id:{self.id_type}>").where(F.col("v") <= version)
        if version > 1:
            rows = rows.groupBy("key").agg(F.max_by(F.struct("n", "first"), "v").alias("x")).select("key", "x.n", "x.first")
        return rows.where("n > 0").select("key", "n", "first")

    def counts(self) -> DataFrame:
        """(key, n, first) of the keys in the index: how many documents hold it, and the smallest of them."""
        return self._counts(self.version)

    def filters(self) -> DataFrame:
        """(shard, present, repeated) of every shard that has keys."""
        rows = self._read("filters", _FILTERS).where(F.col("v") >= self.built)
        return rows.groupBy("shard").agg(F.max_by(F.struct("present", "repeated"), "v").alias("x")).select("shard", "x.present", "x.repeated")

    def _at_keys(self, postings: DataFrame, keys: DataFrame) -> DataFrame:
        """`postings` joined with `keys` (key, n, ...): keys with more documents than a partition has rows meet them by a broadcast."""
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        total = keys.agg(F.sum("n")).first()[0] or 0
        hot = F.col("n") > F.lit(total / parts + 1_000)  # fewer than `parts` keys, as their counts add up to the total
        many = keys.where(hot)
        if not many.limit(1).count():
            return postings.join(keys, "key")
        names = F.broadcast(many.select("key"))
        rest = postings.join(names, "key", "left_anti").join(keys.where(~hot), "key")
        return rest.unionByName(postings.join(F.broadcast(many), "key"))

    def _rebuild_filters(self, version: int, keys: int) -> int:
        """Filters of all keys of `version`, in as many shards as they need; returns how many."""
        shards = 1 << max(0, (keys // SHARD_KEYS).bit_length())
        keyed = self._counts(version).select(_shard(shards).alias("shard"), "key", "n")
        self._write(keyed.groupBy("shard").applyInArrow(_built, _FILTERS), "filters", version)
        return shards

    def _change_filters(self, changes: DataFrame, version: int) -> bool:
        """Bring the filters up to date with (key, was, n); False if one is full."""
        keyed = changes.select(_shard(self.shards).alias("shard"), "key", "was", "n")
        touched = self.filters().join(keyed.select("shard").distinct(), "shard", "left_semi")
        new = keyed.groupBy("shard").cogroup(touched.groupBy("shard")).applyInArrow(_changed, _FILTERS)
        return not self._write(new, "filters", version).where("full").limit(1).count()

    def insert(self, docs: DataFrame) -> None:
        """Add the documents `(doc_id, text)`. An id that is in the index already is an error."""
        version = self.version + 1
        if self.version:
            ids = docs.select(F.col("doc_id").alias("new")).distinct()
            if self.postings().join(ids, F.col("doc_id").eqNullSafe(F.col("new")), "left_semi").limit(1).count():
                raise ValueError("some documents are in the index already; delete them first")
        added = self._write(_keys_of(docs).dropDuplicates(["key", "doc_id"]), "postings", version)
        batch = staged(added.groupBy("key").agg(F.count("*").alias("more"), _smallest().alias("own")), "batch")
        size = batch.count()
        # A batch larger than the index meets all its counts, as its filters are built anew anyway.
        small = bool(self.shards) and size <= self.shards * SHARD_KEYS
        if self.version:
            old = self.counts()
            if small:
                # What its shard's filter lacks is a new key; what it may hold meets the exact counts.
                keyed = batch.select(_shard(self.shards).alias("shard"), "key")
                probed = keyed.groupBy("shard").cogroup(self.filters().groupBy("shard")).applyInArrow(_probed, "shard long, key binary, maybe boolean")
                old = old.join(staged(probed.where("maybe").select("key"), "maybe"), "key", "left_semi")
            known = old.select("key", F.col("n").alias("was"), F.col("first").alias("before"))
            was = F.coalesce("was", F.lit(0))
            first = F.least("own", F.coalesce("before", "own")).alias("first")
            new = batch.join(known, "key", "left").select("key", was.alias("was"), (was + F.col("more")).alias("n"), first)
        else:
            new = batch.select("key", F.lit(0).cast("long").alias("was"), F.col("more").alias("n"), F.col("own").alias("first"))
        new = staged(new, "changes")
        self._write(new.select("key", "n", "first"), "counts", version)
        shards, built = self.shards, self.built
        if not (small and self._change_filters(new, version)):
            shards = self._rebuild_filters(version, self._counts(version).count() if self.version else size)
            built = version
        self._commit(version, shards, built)

    def delete(self, ids: DataFrame) -> None:
        """Take the documents `(doc_id)` out again; ids that the index lacks change nothing."""
        if not self.version:
            return
        version = self.version + 1
        gone = self._write(ids.select(F.col("doc_id").cast(self.id_type)).distinct(), "removed", version).withColumnRenamed("doc_id", "gone")
        live = self.postings()
        leaving = F.col("doc_id").eqNullSafe(F.col("gone"))
        lost = live.join(gone, leaving, "left_semi").select("key").distinct()
        touched = staged(self.counts().join(lost, "key", "left_semi").select("key", F.col("n").alias("was"), "n"), "touched")
        left = self._at_keys(live.join(gone, leaving, "left_anti"), touched).groupBy("key").agg(F.count("*").alias("n"), _smallest().alias("first"))
        new = touched.select("key", "was").join(left, "key", "left").select("key", "was", F.coalesce("n", F.lit(0)).alias("n"), "first")
        new = staged(new, "changes")
        self._write(new.select("key", "n", "first"), "counts", version)
        self._change_filters(new, version)  # keys only leave: there is room
        self._commit(version, self.shards, self.built)

    def repeated_lines(self, docs: DataFrame, filter_bytes: int = FILTER_BYTES) -> DataFrame:
        """(key, doc_id): lines of `docs` (doc_id, text) whose key is kept in a document with a smaller id."""
        filters = self.filters().select("shard", "repeated")
        size = filters.agg(F.sum(F.length("repeated"))).first()[0] or 0
        held = [tuple(r) for r in filters.collect()] if size <= filter_bytes else None
        lines = _keys_of(docs, held, self.shards)
        later = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id") > F.col("first")
        return self._at_keys(lines, self.counts().where("n > 1")).where(later).select("key", "doc_id")

    def kept(self, docs: DataFrame, filter_bytes: int = FILTER_BYTES) -> DataFrame:
        """(doc struct, n_lines, n_dropped, kept string) of every row of `docs`: its text without lines that an earlier document keeps."""
        rows = packed(docs, doc_id="doc_id")
        if not self.version:
            drop = docs.sparkSession.createDataFrame([], f"of {self.id_type}, keys array<binary>")
        else:
            repeated = self.repeated_lines(docs.select("doc_id", "text"), filter_bytes)
            drop = repeated.groupBy(F.col("doc_id").alias("of")).agg(F.collect_set("key").alias("keys"))
        joined = rows.join(drop, F.col("doc_id").eqNullSafe(F.col("of")), "left").select("doc", "keys")

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n_lines, n_dropped, kept = [], [], []
                for text, keys in zip(utf8(batch.column("doc").field("text")), batch.column("keys").to_pylist(), strict=True):
                    lines = text.split(b"\n")
                    n_lines.append(len(lines))
                    if keys:
                        gone = set(keys)
                        lines = [line for line, key in zip(lines, line_keys(text), strict=True) if key not in gone]
                    n_dropped.append(n_lines[-1] - len(lines))
                    kept.append(b"\n".join(lines))
                columns = [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column("doc"), *columns], ["doc", "n_lines", "n_dropped", "kept"])

        kind = joined.schema["doc"].dataType.simpleString()
        return joined.mapInArrow(cut, f"doc {kind}, n_lines long, n_dropped long, kept string")
