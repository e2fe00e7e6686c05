"""Secret scans by a trigram inverted index.

`build_index` writes the postings of every trigram of the corpus (three bytes of UTF-8, A to Z in lower case): documents are taken
in blocks as they stand in a task (some MB of text), and a row has a block, a trigram and the numbers of the block's documents that
have it. A block's row of trigram DIRECTORY has its documents' keys: two hashes of doc_id and text. A task's rows are sorted by
trigram, so that a query reads the pages of its trigrams alone. Nothing is shuffled to build it, and it serves any later rule.

A rule is a regular expression. From it a Boolean query of trigrams is derived (`trigrams`). `candidates` reads the postings that the
queries ask for, intersects and unites them block by block, and turns what is left into keys. `scan` looks each document up among
them and runs the regular expressions of its own rules over its whole text: the verification. Rules without a mandatory trigram run
over every text.

The candidates are broadcast if their counted size is within BROADCAST_ROWS; if not, they are joined by a sort-merge of keys.

Defined results: a null text is empty and has no secrets; null ids and repeated rows are judged row by row; columns of the input
whose names are those of added ones give way.
"""

from __future__ import annotations

import functools
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowmap import Masked
from .store import materialize
from .trigrams import Query, asked, query_of
from .words import SMALL_CHUNK, chunks

#: The trigram of a block's row of keys.
DIRECTORY = -1
INDEX = "block long, trigram int, docs array<int>, key_a array<long>, key_b array<long>"
#: Up to so many candidates (24 bytes each) are broadcast.
BROADCAST_ROWS = 1_000_000
SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


@dataclass(frozen=True)
class Rule:
    """Matches of `pattern`, from left to right without overlap; those whose `group` has under `least` characters are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The first three are fixed by contract. A stretch of 24 hexadecimal digits starts where the digits do, so it is asked for as a whole.
BASE_RULES = (
    Rule("assign", r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Public formats of credentials.
MORE_RULES = (
    Rule("key_block", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("code_host", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("maps", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("payment", r"[rs]k_live_[0-9A-Za-z]{16,}"),
    Rule("web_token", r"eyJ[0-9A-Za-z_-]{10,}\.[0-9A-Za-z_-]{10,}\.[0-9A-Za-z_-]{5,}"),
    Rule("bearer", r"(?ai)bearer\x20+[A-Za-z0-9._~+/=-]{16,}"),
    Rule("url_login", r"[A-Za-z][A-Za-z0-9+.-]{1,20}://[^\x00-\x20/:@]{1,100}:[^\x00-\x20/:@]{1,100}@"),
)
RULES = BASE_RULES + MORE_RULES


def spans_of(text: str, rules: list[tuple[Rule, re.Pattern]]) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every match, by start, then in the order of the rules."""
    found = []
    for order, (rule, pattern) in enumerate(rules):
        found += [(m.start(), order, m.end(), rule.kind) for m in pattern.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]
    return [(kind, start, end) for start, _, end, kind in sorted(found)]


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes in lower case, one behind the other, and where each begins and the last ends."""
    data = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
    raw = data.buffers()[2]
    own = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and raw.size else np.empty(0, np.uint8)
    return _FOLD[own], offsets - offsets[0]


def _codes(data: np.ndarray) -> np.ndarray:
    wide = data.astype(np.int32)
    return wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:]


def postings(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(trigram, document), each pair once, in that order. One long text is read in steps."""
    n = len(offsets) - 1
    if n == 1:
        seen = np.zeros(1 << 24, bool)
        for at in range(0, max(len(data) - 2, 0), SMALL_CHUNK):
            seen[_codes(data[at : at + SMALL_CHUNK + 2])] = True
        own = np.flatnonzero(seen)
        return own, np.zeros(len(own), np.int64)
    if len(data) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    counts = np.diff(offsets)
    doc = np.repeat(np.arange(n), counts)[:-2]
    inside = np.arange(len(doc)) + 3 <= offsets[1:][doc]
    pairs = np.unique((_codes(data).astype(np.int64) * n + doc)[inside])
    return pairs // n, pairs % n


def _index_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, limit=SMALL_CHUNK):
        trigram, doc = postings(*_bytes(batch.column("text")))
        first = np.flatnonzero(np.diff(trigram, prepend=-1))
        block = uuid.uuid4().int >> 65
        docs = pa.ListArray.from_arrays(pa.array(np.r_[first, len(doc)], pa.int32()), pa.array(doc, pa.int32()))
        keys = [pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column(c)) for c in ("key_a", "key_b")]
        n, none = len(first), pa.nulls(len(first), pa.list_(pa.int64()))
        yield pa.record_batch([pa.array([block], pa.int64()), pa.array([DIRECTORY], pa.int32()), pa.nulls(1, pa.list_(pa.int32())), *keys], names=["block", "trigram", "docs", "key_a", "key_b"])
        yield pa.record_batch([pa.array(np.full(n, block)), pa.array(trigram[first], pa.int32()), docs, none, none], names=["block", "trigram", "docs", "key_a", "key_b"])


def _keyed(df: DataFrame, id_name: str, text: str) -> DataFrame:
    key = F.xxhash64(id_name, text), F.xxhash64(F.lit(DIRECTORY), id_name, text)
    return df.withColumns({"key_a": key[0], "key_b": key[1]})


def build_index(docs: DataFrame, id_name: str = "doc_id", text: str = "text") -> DataFrame:
    """The index of the whole texts (INDEX), written into the shared folder."""
    rows = docs.select(F.col(id_name).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = _keyed(rows, "doc_id", "text").select("text", "key_a", "key_b")
    return materialize(rows.mapInArrow(_index_batches, INDEX).sortWithinPartitions("trigram"), "trigram-index")


def _selected(query: Query, lists: Column) -> Column:
    """The documents of a block that satisfy the query, from its lists by trigram."""
    if isinstance(query, int):
        return F.coalesce(lists[F.lit(query)], F.array().cast("array<int>"))
    parts = [_selected(q, lists) for q in sorted(query[1], key=repr)]
    return functools.reduce(F.array_intersect if query[0] == "and" else F.array_union, parts)


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(key_a, key_b, rules): the documents that satisfy the trigram query of some rule, and the numbers of those rules. Rules
    without a mandatory trigram aren't asked."""
    queries = {i: q for i, q in enumerate(query_of(r.pattern) for r in rules) if q is not True}
    wanted = sorted(set().union(*(asked(q) for q in queries.values()))) if queries else []
    lists = index.where(F.col("trigram").isin(wanted)).groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "docs"))).alias("lists"))
    each = F.array(*(F.struct(F.lit(i).alias("rule"), _selected(q, F.col("lists")).alias("docs")) for i, q in queries.items())) if queries else F.array().cast("array<struct<rule:int,docs:array<int>>>")
    found = lists.select("block", F.explode(F.filter(each, lambda x: F.size(x["docs"]) > 0)).alias("x")).select("block", "x.rule", F.explode("x.docs").alias("doc"))
    own = found.groupBy("block", "doc").agg(F.sort_array(F.collect_set("rule")).alias("rules"))
    directory = index.where(F.col("trigram") == DIRECTORY).select("block", "key_a", "key_b")
    keys = own.groupBy("block").agg(F.collect_list(F.struct("doc", "rules")).alias("own")).join(directory, "block")
    keys = keys.select("key_a", "key_b", F.explode("own").alias("x")).select(F.get("key_a", F.col("x.doc")).alias("key_a"), F.get("key_b", F.col("x.doc")).alias("key_b"), "x.rules")
    return keys.groupBy("key_a", "key_b").agg(F.first("rules").alias("rules"))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, index: DataFrame | None = None, keep_text: bool = True, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """`docs` (doc_id, text) with `spans` (kind, start, end; code points, end exclusive), by start, then in the order of the rules. `index`: of
    these documents, if there is one already."""
    m = Masked(docs)
    rows, column = m.as_string(m.df, "text")
    index = build_index(rows, m.name("doc_id"), column) if index is None else index
    asked_for = materialize(candidates(index, rules), "secret-candidates")
    small = asked_for.count() <= broadcast_rows
    keyed = _keyed(rows.withColumn("_whole", F.coalesce(column, F.lit(""))), m.name("doc_id"), "_whole").drop("_whole")
    both = keyed.join(asked_for.hint("broadcast" if small else "merge"), ["key_a", "key_b"], "left").drop("key_a", "key_b")
    everywhere = [i for i, r in enumerate(rules) if query_of(r.pattern) is True]
    gone = {"_as_text", "rules"} | (set() if keep_text else {m.name("text")})
    kept = [f for f in both.schema.fields if f.name not in gone]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [(r, re.compile(r.pattern)) for r in rules]
        for batch in chunks(batches, column):
            found = []
            for text, own in zip(batch.column(column).to_pylist(), batch.column("rules").to_pylist()):
                todo = everywhere if own is None else sorted({*everywhere, *own})
                found.append([{"kind": k, "start": s, "end": e} for k, s, e in spans_of(text or "", [compiled[i] for i in todo])])
            spans = pa.array(found, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), spans], names=[*(f.name for f in kept), "spans"])

    out = both.mapInArrow(run, T.StructType([*(T.StructField(f.name, f.dataType, True) for f in kept), T.StructField("spans", T.ArrayType(SPAN))]))
    return m.restore(out, ["spans"], [f.name for f in kept])


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
