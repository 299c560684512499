"""Line deduplication over levelled sorted runs of line hashes.

A run is a table bucketed and sorted by line hash that holds, for each line key, in how many documents it stands and
the largest doc_id among them. Documents come in batches of falling doc_id, so that the largest holder
of a key comes first and a key is settled once enough documents hold it. A batch is merge-anti-joined
with the runs, which takes out settled keys, and what is left becomes a run of its own. When a level has
`fan_in` runs they are merged into one run of the next level. At the end the runs name the keys to
drop, and each document loses them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import remove, save, save_sorted, small
from .textops import LOWER_TABLE

SPACES = " \t\n\x0b\x0c\r"

#: Documents of a batch at most; a table is dealt into BATCHES of them at least.
BATCH_ROWS, BATCHES = 50_000_000, 4
#: Rows that the rewriting step holds as Python objects at once.
SLICE = 512
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The key of a line: stripped of ASCII whitespace, A-Z lower-cased."""
    line = F.btrim(line, F.lit(SPACES))
    return F.when(F.octet_length(line) == F.char_length(line), F.lower(line)).otherwise(F.translate(line, _UPPER, _LOWER))


def occurrences(docs: DataFrame, least: int) -> DataFrame:
    """(key, doc_id) of every different line key of at least `least` code points in each row of `docs`; a key is the MD5 digest of its text."""
    long = F.filter(F.split("text", "\n", -1), lambda x: F.octet_length(x) >= least)
    rows = docs.where("doc_id is not null and text is not null").select("doc_id", F.explode(F.array_distinct(F.transform(long, line_key))).alias("k"))
    return rows.where(F.char_length("k") >= least).select(F.unhex(F.md5(F.col("k").cast("binary"))).alias("key"), "doc_id")


class RunStore:
    """Levelled sorted runs of (key, n_docs, last_doc) in the shared folder.

    n_docs of a settled key is a lower bound; last_doc is exact once the key is settled.
    """

    def __init__(self, least_docs: int = 3, fan_in: int = 2):
        self.least_docs, self.fan_in = least_docs, fan_in
        self.levels: list[list[DataFrame]] = [[]]

    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        """One table of the runs' keys: sorted, bucketed runs meet in merge joins."""
        every = runs[0].select("key", "n_docs", "last_doc")
        for r in runs[1:]:
            other = r.select("key", F.col("n_docs").alias("n2"), F.col("last_doc").alias("l2")).hint("merge")
            n = F.coalesce("n_docs", F.lit(0)) + F.coalesce("n2", F.lit(0))
            every = every.join(other, "key", "full_outer").select("key", n.alias("n_docs"), F.greatest("last_doc", "l2").alias("last_doc"))
        return every

    def add(self, occurrences: DataFrame) -> None:
        """Take a batch of (key, doc_id), whose ids are below those of earlier batches, as a sorted run; compact full levels."""
        run = self.unsettled(occurrences.groupBy("key").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_doc")))
        self.levels[0].append(save_sorted(run, "line_run_0", "key"))
        for k in range(len(self.levels)):
            if len(level := self.levels[k]) >= self.fan_in:
                if k + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[k + 1].append(save_sorted(self._merged(level), f"line_run_{k + 1}", "key"))
                self.levels[k] = []
                for r in level:
                    remove(r)

    def clear(self) -> None:
        for r in self.runs():
            remove(r)
        self.levels = [[]]

    def unsettled(self, rows: DataFrame) -> DataFrame:
        """The rows whose keys the runs don't hold often enough yet: a merge-anti-join with the runs, whose counts add up."""
        held = F.lit(0).cast("long")
        for k, r in enumerate(self.runs()):
            rows = rows.join(r.select("key", F.col("n_docs").alias(f"_n{k}")).hint("merge"), "key", "left")
            held = held + F.coalesce(f"_n{k}", F.lit(0))
        return rows.where(held < self.least_docs).select("key", "n_docs", "last_doc")

    def frequent(self) -> DataFrame:
        """Keys that stand in enough documents over all runs, with the largest doc_id of each."""
        runs = self.runs()
        return (runs[0] if len(runs) == 1 else self._merged(runs)).where(F.col("n_docs") >= self.least_docs)


def _key(line: bytes, least: int) -> bytes | None:
    """The digest that occurrences() gives to a line, or None below `least` code points."""
    line = line.strip(SPACES.encode())
    if len(line) < least or (not line.isascii() and sum(b & 0xC0 != 0x80 for b in line) < least):
        return None
    return hashlib.md5(line.translate(LOWER_TABLE), usedforsecurity=False).digest()


def _rewrite(least: int, columns: list[str]):
    at, drop_at = columns.index("text"), columns.index("drop_keys")

    def rewritten(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, lines_of, dropped_of = [], [], []
        for value, gone in zip(batch.column(at), batch.column(drop_at), strict=True):
            raw = value.as_buffer().to_pybytes() if value.is_valid else None
            lines_of.append((raw.count(b"\n") if raw else 0) + 1)
            if gone.is_valid and raw:
                keys = {k.as_py() for k in gone.values}
                kept = [line for line in raw.split(b"\n") if _key(line, least) not in keys]
                raw = b"\n".join(kept)
                dropped_of.append(lines_of[-1] - len(kept))
            else:
                dropped_of.append(0)
            texts.append(raw)
        rest = [c for i, c in enumerate(batch.columns) if i not in (at, drop_at)]
        names = [c for i, c in enumerate(columns) if i not in (at, drop_at)]
        return pa.RecordBatch.from_arrays([*rest, pa.array(texts, type=pa.binary()).cast(pa.string()), pa.array(lines_of, type=pa.int64()), pa.array(dropped_of, type=pa.int64())], names=[*names, "text", "n_lines", "n_dropped"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                yield rewritten(batch.slice(i, SLICE))

    return run


def drop_repeated_lines(docs: DataFrame, least_chars: int = 20, least_docs: int = 3, batches: int | None = None, fan_in: int = 2) -> DataFrame:
    """The documents, all their columns kept, with repeated lines dropped, and n_lines and n_dropped added.

    A key of at least `least_chars` code points that stands in at least `least_docs` documents loses all
    its lines except in the largest doc_id that holds it (there all of them stay). Lines are split at
    \\n; a null text stays null and counts as one empty line, an empty one stays empty. A document without
    a doc_id takes no part and is kept as it is; rows that repeat a doc_id are one document, whose rows each
    keep or lose their lines. An empty table gives an empty one. Input columns named n_lines, n_dropped or
    drop_keys are replaced. Keys are compared by their MD5 digests: two lines of one digest would count as
    one. `batches`: by default as many as the rows ask for, BATCHES at least.
    """
    docs = docs.drop("n_lines", "n_dropped", "drop_keys")
    slim = docs.select("doc_id", "text")
    repeated = save(slim.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "line-repeated")
    found = occurrences(slim, least_chars)
    if repeated.count():
        ids = small(repeated)
        found = found.join(ids, "doc_id", "left_anti").select("key", "doc_id").union(found.join(ids, "doc_id", "left_semi").select("key", "doc_id").distinct())
    if batches is None:
        batches = max(BATCHES, -(-slim.count() // BATCH_ROWS))
    cuts = slim.select(F.percentile_approx("doc_id", [(batches - k) / batches for k in range(1, batches)], 1000)).first()[0] if batches > 1 else None
    batch = F.lit(0)
    for cut in cuts or []:
        batch = batch + (F.col("doc_id") < F.lit(cut)).cast("int")
    found = save(found.withColumn("batch", batch), "line-keys")
    store = RunStore(least_docs, fan_in)
    for b in range(batches):
        store.add(found.where(F.col("batch") == b).select("key", "doc_id"))
    frequent = save(store.frequent().select("key", "last_doc"), "line-frequent")
    # a very common line is one key: where the keys are too many to broadcast, adaptive execution splits its rows among tasks
    gone = found.select("key", "doc_id").join(small(frequent), "key").where("doc_id <> last_doc")
    gone = save(gone.groupBy(F.col("doc_id").alias("of")).agg(F.collect_set("key").alias("drop_keys")), "line-drops")
    store.clear()
    remove(found)
    joined = docs.join(small(gone), F.col("doc_id") == F.col("of"), "left").drop("of")
    kinds = {f.name: f.dataType.simpleString() for f in joined.schema}
    rest = [c for c in joined.columns if c not in ("text", "drop_keys")]
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in rest) + (", " if rest else "") + "text string, n_lines long, n_dropped long"
    return joined.mapInArrow(_rewrite(least_chars, joined.columns), schema)


def kept_digest(rows: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of the kept text."""
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int, str | None]], least_chars: int = 20, least_docs: int = 3) -> dict[int, tuple[int, int, str]]:
    """The rule applied line by line in memory, for tests."""
    key = lambda line: line.strip(" \t\n\v\f\r").translate({c: c + 32 for c in range(65, 91)})
    where: dict[str, set[int]] = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            where.setdefault(key(line), set()).add(doc)
    out = {}
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(k := key(x)) >= least_chars and len(where[k]) >= least_docs and max(where[k]) != doc)]
        out[doc] = (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out
