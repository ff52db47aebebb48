"""Repeated passages, found with a log-structured index of window fingerprints.

A window is WINDOW consecutive words of one document.  Its fingerprint is the
least hash of its runs of RUN words, at the leftmost place that has it.  Equal
windows have equal fingerprints, and neighbouring windows mostly share one, so
an entry stands for about twenty windows.  It holds the fingerprint, the
document and place, and a digest of the entry's context: all words that its
windows can reach.  Entries of one context are a class, and have equal windows.

The index is a list of immutable runs, each bucketed and sorted by fingerprint,
with one row for each class: the first document and place that has it.  A batch
of documents, whose ids lie above all earlier ones, is ingested like this:

* Its fingerprints are merge-joined with the runs, bucket by bucket, so history
  isn't shuffled.  What has one of them is looked at together with the batch.
* A class that occurs in several documents is repeated as a whole.  Classes that
  share a fingerprint and not the context may still share windows: one document
  of each is read again and its windows are compared by a digest of their words.
  All equality is decided by 128-bit digests of the words themselves, so what
  the fingerprints propose is verified before a word goes.
* The batch's new classes become a run.  Runs are compacted in tiers: FAN_IN
  runs of one tier become one of the next, before the next batch is joined.

Texts are kept beside the runs, bucketed by document, so that a later session
needs nothing but the index's folder to ingest another batch.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.llm import _words
from siftstone.llm._joins import dealt_anew
from siftstone.llm._scratch import discard, materialise, shuffles_end_with_the_write
from siftstone.sources.shared import remove, scratch_path

WINDOW = 50
RUN = 8
#: Batches of the whole table, and runs of a tier that are compacted.
BATCHES, FAN_IN = 3, 2


# ---------------------------------------------------------------- entries and windows


def _least(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The least of each ``width`` consecutive values, and its leftmost place."""
    places, reach = np.arange(len(values)), 1

    def joined(values, places, shift, count):
        left, right = values[:count], values[shift : shift + count]
        later = right < left
        return np.where(later, right, left), np.where(later, places[shift : shift + count], places[:count])

    while reach * 2 <= width:
        values, places = joined(values, places, reach, len(values) - reach)
        reach *= 2
    rest = width - reach
    return joined(values, places, rest, len(values) - rest) if rest else (values, places)


def _entries(hashes: np.ndarray, bounds: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Fingerprint, place, first window and number of windows of each entry, and its document; words are numbered through the chunk."""
    run, count = min(RUN, window), len(hashes) - window + 1
    if count <= 0:
        return (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 4)
    values, places = _least(_words.hash_runs(hashes, run, seed=2), window - run + 1)
    document = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[:count]
    inside = np.arange(count) + window <= bounds[document + 1]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | (places[1:] != places[:-1]) | (document[1:] != document[:-1])
    firsts = np.flatnonzero(begins)
    # an entry ends where the next begins or windows no longer fit
    sizes = np.add.reduceat(inside, firsts) if len(firsts) else np.zeros(0, np.int64)
    return values[firsts], places[firsts], firsts, sizes.astype(np.int64), document[firsts]


def _joined(words: _words.Words) -> tuple[bytes, np.ndarray]:
    """The chunk's words, each with a space after it, and where each begins; one more place for the end."""
    lengths = words.ends - words.starts + 1
    begins = np.concatenate([[0], np.cumsum(lengths)])
    source = np.arange(begins[-1]) + np.repeat(words.starts - begins[:-1], lengths)
    out = np.append(words.data, np.uint8(32))[source]
    out[begins[1:] - 1] = 32
    return out.tobytes(), begins


def _digest(raw: bytes) -> bytes:
    return blake2b(raw, digest_size=16).digest()


_ENTRY = pa.struct([("fingerprint", pa.int64()), ("context", pa.binary()), ("place", pa.int32()), ("first", pa.int32()), ("windows", pa.int32())])
_PROFILE = (
    "doc_id long, own long, n_words long, all_sha256 binary, entries array<struct<fingerprint:long,context:binary,place:int,first:int,windows:int>>"
)


def _profile(window: int):
    """A row (doc_id, own, text) becomes its number of words, the digest of all of them, and its entries."""
    run = min(RUN, window)

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, words in _words.text_chunks(batch, "text"):
                raw, begins = _joined(words)
                bounds = words.bounds
                prints, places, firsts, sizes, document = _entries(_words.hash_words(words, lower=False), bounds, window)
                low = np.maximum(bounds[document], places - (window - run))
                high = np.minimum(bounds[document + 1], places + window)
                reach = np.stack([places - low, high - places], axis=1).astype("<u4")  # where a document's ends cut it
                spans = zip(reach, begins[low].tolist(), (begins[high] - 1).tolist())
                contexts = [_digest(r.tobytes() + raw[a:z]) for r, a, z in spans]
                edges = begins[bounds].tolist()
                own = bounds[document]
                columns = [prints.view(np.int64), contexts, *(x.astype(np.int32) for x in (places - own, firsts - own, sizes))]
                offsets = np.searchsorted(document, np.arange(len(bounds))).astype(np.int32)
                yield pa.record_batch(
                    [
                        *(batch.column(i).slice(first, last - first) for i in (0, 1)),
                        pa.array(np.diff(bounds), pa.int64()),
                        pa.array([sha256(raw[a : max(a, z - 1)]).digest() for a, z in zip(edges, edges[1:])], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ENTRY)], fields=list(_ENTRY))),
                    ],
                    names=["doc_id", "own", "n_words", "all_sha256", "entries"],
                )

    return profile


def _windows(window: int):
    """Rows (digest, doc_id, context, shift) of the windows of the entries that are asked for; shift is from the entry's place."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column(batch.schema.get_field_index("wanted"))
            for first, last, words in _words.text_chunks(batch, "text"):
                raw, begins = _joined(words)
                starts = begins.tolist()
                digests, owner, contexts, shifts = [], [], [], []
                ids = batch.column(0).slice(first, last - first).to_pylist()
                for i, (base, doc) in enumerate(zip(words.bounds.tolist(), ids)):
                    own = wanted[first + i].values
                    places, firsts, sizes = (own.field(n).to_pylist() for n in ("place", "first", "windows"))
                    for context, place, begin, size in zip(own.field("context").to_pylist(), places, firsts, sizes):
                        digests += [_digest(raw[starts[at] : starts[at + window] - 1]) for at in range(base + begin, base + begin + size)]
                        owner += [doc] * size
                        contexts += [context] * size
                        shifts += range(begin - place, begin - place + size)
                    if len(digests) > 50_000:
                        yield _window_rows(digests, owner, contexts, shifts)
                        digests, owner, contexts, shifts = [], [], [], []
                yield _window_rows(digests, owner, contexts, shifts)

    return windows


def _window_rows(*columns: list) -> pa.RecordBatch:
    kinds = (pa.binary(), pa.int64(), pa.binary(), pa.int32())
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=["digest", "doc_id", "context", "shift"])


def _cut(window: int):
    """A text with the windows that go (first, windows) becomes its number of words removed and the digest of the others."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = batch.column(batch.schema.get_field_index("gone"))
            for first, last, words in _words.text_chunks(batch, "text"):
                raw, begins = _joined(words)
                octets = np.frombuffer(raw, np.uint8)
                removed, kept = [], []
                bounds = words.bounds.tolist()
                for i, (a, z) in enumerate(zip(bounds, bounds[1:])):
                    spans = gone[first + i].values
                    at, size = (spans.field(n).to_numpy(zero_copy_only=False) for n in ("first", "windows"))
                    change = np.zeros(z - a + 1, np.int64)
                    np.add.at(change, at, 1)
                    np.add.at(change, at + size + window - 1, -1)
                    stays = np.cumsum(change)[:-1] == 0
                    removed.append(int((~stays).sum()))
                    left = octets[begins[a] : begins[z]][np.repeat(stays, np.diff(begins[a : z + 1]))].tobytes()
                    kept.append(sha256(left[:-1]).hexdigest())
                yield pa.record_batch(
                    [*(batch.column(i).slice(first, last - first) for i in (0, 1)), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                    names=["doc_id", "own", "n_removed", "kept_sha256"],
                )

    return cut


# ---------------------------------------------------------------- the index


_RUN = "fingerprint long, context binary, doc_id long, own long, place int, first int, windows int"
_TEXTS = "doc_id long, own long, text string"
_MANIFEST = "version long, `window` int, buckets int, last_id long, runs array<struct<folder:string,tier:int>>, texts array<string>"


class FingerprintIndex:
    """Runs and texts in a folder.

    Each change appends a version to the manifest; tables are listed only after
    they are whole, and deleted only after they are no longer listed, so an
    ingest that breaks off leaves the index as it was.
    """

    def __init__(self, spark: SparkSession, path: str, window: int = WINDOW, fan_in: int = FAN_IN, buckets: int | None = None):
        """The index in ``path``, or an empty one.

        An existing index keeps its window and its buckets.  A new one should
        get so many buckets that a bucket of a batch's texts fits a task; the
        default is the session's number of shuffle partitions.
        """
        self.spark, self.path, self.fan_in = spark, path.rstrip("/"), fan_in
        self.window, self.buckets = window, buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.version, self.last_id, self.runs, self.texts = 0, None, [], []
        self._tables: dict[str, str] = {}
        kept = self._manifest()
        if kept:
            self.version, self.window, self.buckets, self.last_id = kept.version, kept.window, kept.buckets, kept.last_id
            self.runs, self.texts = [(r.folder, r.tier) for r in kept.runs], list(kept.texts)

    def _manifest(self):
        from pyspark.errors import AnalysisException

        try:
            return self.spark.read.schema(_MANIFEST).json(f"{self.path}/manifest").orderBy(F.desc("version")).first()
        except AnalysisException:  # there is none yet
            return None

    def _commit(self) -> None:
        self.version += 1
        row = (self.version, self.window, self.buckets, self.last_id, self.runs, self.texts)
        self.spark.createDataFrame([row], _MANIFEST).coalesce(1).write.mode("append").json(f"{self.path}/manifest")

    def _write(self, rows: DataFrame, kind: str, key: tuple[str, ...]) -> str:
        folder, name = f"{kind}-{uuid.uuid4().hex}", f"siftstone_{uuid.uuid4().hex}"
        with shuffles_end_with_the_write(self.spark):
            rows.repartition(self.buckets, *key).write.bucketBy(self.buckets, *key).sortBy(*key).option("path", f"{self.path}/{folder}").saveAsTable(name)
        self._tables[folder] = name
        return folder

    def _table(self, folder: str) -> DataFrame:
        """A run or texts as Spark's bucketed table, which a new session has to be told of."""
        if folder not in self._tables:
            name = f"siftstone_{uuid.uuid4().hex}"
            schema, key = (_RUN, "fingerprint") if folder.startswith("run") else (_TEXTS, "doc_id, own")
            self.spark.sql(f"create table {name} ({schema}) using parquet clustered by ({key}) sorted by ({key}) into {self.buckets} buckets location '{self.path}/{folder}'")
            self._tables[folder] = name
        return self.spark.table(self._tables[folder])

    def _drop(self, folders: list[str]) -> None:
        for folder in folders:
            if name := self._tables.pop(folder, None):
                self.spark.sql(f"drop table if exists {name}")
            remove(self.spark, f"{self.path}/{folder}")

    def compact(self) -> bool:
        """Merge the runs of the lowest tier that has ``fan_in`` of them into one of the next; whether there was one."""
        tiers = sorted({t for _, t in self.runs if sum(u == t for _, u in self.runs) >= self.fan_in})
        if not tiers:
            return False
        old = [f for f, t in self.runs if t == tiers[0]]
        merged = self._table(old[0])
        for folder in old[1:]:
            merged = merged.unionByName(self._table(folder))
        new = self._write(merged, "run", ("fingerprint",))
        self.runs = [r for r in self.runs if r[0] not in old] + [(new, tiers[0] + 1)]
        self._commit()
        self._drop(old)
        return True

    def ingest(self, docs: DataFrame) -> DataFrame:
        """Add the rows (doc_id, text); one row for each: doc_id, n_words, n_removed, kept_sha256.

        Ids must lie above all that were ingested before, else ValueError.
        """
        window = self.window
        least, most = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
        if least is not None and self.last_id is not None and least <= self.last_id:
            raise ValueError(f"a batch must have ids above {self.last_id}")
        while self.compact():
            pass
        rows = docs.select("doc_id", F.xxhash64("text").alias("own"), "text")
        profiles = materialise(rows.mapInArrow(_profile(window), _PROFILE), "profiles")
        long = rows.where(F.col("doc_id").isNotNull() & (F.length("text") >= 2 * window - 1))  # no shorter text has a window
        texts = [*self.texts, self._write(long, "texts", ("doc_id", "own"))]

        entries = profiles.where("doc_id is not null").select("doc_id", "own", F.inline("entries"))
        met = self._met(entries)
        both = entries.withColumn("old", F.lit(False))
        both = both if met is None else both.unionByName(met.withColumn("old", F.lit(True)))
        place = F.struct("doc_id", "own", "place", "first", "windows", "fingerprint")
        classes = materialise(
            both.groupBy("context").agg(F.min(place).alias("least"), F.max("doc_id").alias("last"), F.max("old").alias("old")).select("context", "least.*", "last", "old"),
            "classes",
        )
        run = self._write(classes.where("not old").select(*(c.split()[0] for c in _RUN.split(", "))), "run", ("fingerprint",))
        repeated = classes.where("last > doc_id").select("context", F.col("doc_id").alias("least"), F.lit(None).cast("array<int>").alias("shifts"))
        parted, used = self._parted(self._table(run), classes.where("old"), texts)
        found = repeated.unionByName(parted)

        # of a repeated class all windows go in all but its first document; there, those that an older one has
        same = dealt_anew(entries, found.withColumnRenamed("context", "other"), "context", right_key="other")
        whole = same.where("shifts is null and doc_id > least").select("doc_id", "own", "first", "windows")
        some = same.where("shifts is not null and doc_id = least").select("doc_id", "own", "place", F.explode("shifts").alias("shift"))
        some = some.select("doc_id", "own", (F.col("place") + F.col("shift")).alias("first"), F.lit(1).alias("windows"))
        gone = whole.unionByName(some).groupBy("doc_id", "own").agg(F.collect_list(F.struct("first", "windows")).alias("gone"))
        cut = materialise(
            gone.join(self._table(texts[-1]), ["doc_id", "own"]).select("doc_id", "own", "text", "gone")
            .mapInArrow(_cut(window), "doc_id long, own long, n_removed long, kept_sha256 string").distinct(),
            "cut",
        )
        self.runs, self.texts = [*self.runs, (run, 0)], texts
        self.last_id = self.last_id if most is None else most
        self._commit()
        plain = F.lower(F.hex("all_sha256"))
        joined = profiles.drop("entries").join(cut, ["doc_id", "own"], "left")
        done = materialise(
            joined.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("kept_sha256", plain).alias("kept_sha256")),
            "words",
        )
        for table in (profiles, classes, cut, *used, *([] if met is None else [met])):
            discard(table)
        return done

    def _met(self, entries: DataFrame) -> DataFrame | None:
        """What the runs have of the fingerprints of ``entries``."""
        prints, met = entries.select("fingerprint").distinct(), None
        for folder, _ in self.runs:
            own = self._table(folder).join(prints.hint("merge"), "fingerprint", "left_semi")
            met = own if met is None else met.unionByName(own)
        return None if met is None else materialise(met, "met")

    def _parted(self, run: DataFrame, old: DataFrame, texts: list[str]) -> tuple[DataFrame, list[DataFrame]]:
        """(context, least, shifts): of a new class, whose first document is ``least``, the windows that an older document has in another class.

        Also the tables that this is read from.
        """
        known = old.select("fingerprint").distinct().withColumn("known", F.lit(True))
        shared = run.groupBy("fingerprint").agg(F.count("*").alias("n")).join(known, "fingerprint", "left").where("n > 1 or known").select("fingerprint")
        columns = ("doc_id", "own", "place", "first", "windows")
        mine = run.join(shared, "fingerprint", "left_semi").select(*columns, "context")
        theirs = dealt_anew(old, shared, "fingerprint").select(*columns, F.lit(None).cast("binary").alias("context"))
        wanted = materialise(
            mine.unionByName(theirs).groupBy("doc_id", "own").agg(F.collect_set(F.struct("context", "place", "first", "windows")).alias("wanted")), "wanted"
        )
        asked = None
        for folder in texts:
            own = wanted.join(self._table(folder), ["doc_id", "own"]).select("doc_id", "text", "wanted")
            own = own.mapInArrow(_windows(self.window), "digest binary, doc_id long, context binary, shift int")
            asked = own if asked is None else asked.unionByName(own)
        asked = materialise(asked, "windows")
        oldest = asked.groupBy("digest").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).where("a < z").select("digest", "a")
        covered = dealt_anew(asked.where("context is not null"), oldest, "digest").where("doc_id > a")
        return covered.groupBy("context").agg(F.min("doc_id").alias("least"), F.collect_set("shift").alias("shifts")), [wanted, asked]


def repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, batches: int = BATCHES, fan_in: int = FAN_IN) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed and kept_sha256.

    The rows are ingested into a new index, in ``batches`` of rising ids.  A
    null text has no words.  A row without an id neither loses words nor takes
    them from others.  Rows that repeat an id are judged against smaller ids
    only, so they don't remove each other's words.  Other columns are not read.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    index = FingerprintIndex(spark, scratch_path(spark, "index"), window, fan_in)
    cuts = texts.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)])).first()[0] if batches > 1 else []
    edges = [None, *sorted(set(cuts or [])), None]
    out = None
    for low, high in zip(edges, edges[1:]):
        batch = texts if low is None else texts.where(F.col("doc_id") > low)
        # rows without an id come with the first batch
        batch = batch if high is None else batch.where((F.col("doc_id") <= high) | F.col("doc_id").isNull())
        done = index.ingest(batch)
        out = done if out is None else out.unionByName(done)
    return out
