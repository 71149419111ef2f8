"""Scrubbing a table of documents: find, allocate, apply, in barriers.

1. Addresses are found and allocated, since audit fields may hold an address's token.
2. User names, names and organisations are found on the text with addresses replaced,
   and allocated; names also from labelled fields of the original text. Words of full
   names join the dictionary.
3. Each document is rewritten with its own tokens and the part of the dictionary it may see.
4. Values found by their form follow: technical kinds one barrier each, as a later kind's
   value may hold an earlier kind's token; the others in one.
5. What is left is counted.

Finding and applying are narrow passes over whole texts. Each barrier's texts are written
as a compressed table, of which the next step reads the columns it needs, and deleted once
the next barrier's are written. A text without addresses is not read again for 2, nor one
without values of the last barrier for 5: most texts are written twice in all. Only documents that hold values
meet the map, by a join on their id; the rest of the texts are never shuffled. The
dictionary is broadcast while it is small, by a count; a larger one is joined to the
documents' distinct words and pairs of words. Either way an entry is looked up by the rarest
pair of its words (by its word, if it has one), as one word may be shared by all names.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import pairwise

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import passes as P
from ..functions import textops as t
from ..plans.cut import cut, drop_written, spread, written
from . import allocate as A
from .ner import recognised_names
from .options import Options

_FOUND = pa.list_(pa.struct([("pass", pa.int32()), ("pos", pa.int64()), ("kind", pa.string()), ("key", pa.string()), ("value", pa.string())]))
_FOUND_DDL = "array<struct<pass:int,pos:bigint,kind:string,key:string,value:string>>"
_HITS = pa.list_(pa.struct([("pass", pa.int32()), ("seq", pa.int32()), ("kind", pa.string()), ("original", pa.string()), ("replacement", pa.string())]))
_HITS_DDL = "array<struct<pass:int,seq:int,kind:string,original:string,replacement:string>>"
_PAIRS = pa.list_(pa.struct([("kind", pa.string()), ("value", pa.string())]))
_PAIRS_DDL = "array<struct<kind:string,value:string>>"


@dataclass
class Scrubbed:
    """Tables of one run: documents with text, original and ner_status; hits; residuals; the map."""

    documents: DataFrame
    hits: DataFrame
    residuals: DataFrame
    pii_map: DataFrame


class _Notes:
    """Values found in one document, with stand-ins for their tokens."""

    def __init__(self) -> None:
        self.rows: list[dict] = []

    def give(self, no: int, kind: str, value: str) -> str:
        self.rows.append({"pass": no, "pos": len(self.rows), "kind": kind, "key": t.key_of(kind, value), "value": value})
        return P.STAND_IN[kind]


class _Tokens:
    """A document's tokens by kind and key; names that are mapped to themselves stay."""

    def __init__(self, entries: list[dict] | None) -> None:
        self.of = {(e["kind"], e["key"]): e["token"] for e in entries or []}

    def give(self, no: int, kind: str, value: str) -> str:
        return self.of[kind, t.key_of(kind, value)]


class _Hits:
    def __init__(self, before: list[dict] | None = None) -> None:
        self.rows = list(before or [])

    def log(self, no: int, kind: str, original: str, replacement: str) -> None:
        self.rows.append({"pass": no, "seq": len(self.rows), "kind": kind, "original": original, "replacement": replacement})


def _quiet(*_: object) -> None:
    return None


def _plain(column: pa.Array) -> list:
    """A column's values; strings and whole numbers by NumPy, which takes a tenth of ``to_pylist``'s time."""
    kind = column.type
    if pa.types.is_string(kind) or pa.types.is_large_string(kind) or pa.types.is_integer(kind) and not column.null_count:
        return column.to_numpy(zero_copy_only=False).tolist()
    return column.to_pylist()


def _values(column: pa.Array) -> list:
    """A column's values; structs in lists by their fields' columns, which takes a quarter of ``to_pylist``'s time."""
    if not (pa.types.is_list(column.type) and pa.types.is_struct(column.type.value_type)):
        return _plain(column)
    ends = _plain(column.offsets)
    inner = column.values.slice(ends[0], ends[-1] - ends[0])
    if inner.null_count:
        return column.to_pylist()
    names = [f.name for f in column.type.value_type]
    items = [dict(zip(names, x, strict=True)) for x in zip(*map(_plain, inner.flatten()), strict=True)]
    lists = [items[a - ends[0] : b - ends[0]] for a, b in pairwise(ends)]
    return lists if not column.null_count else [x if there else None for x, there in zip(lists, column.is_valid().to_pylist(), strict=True)]


def _rows(batch: pa.RecordBatch) -> list[dict]:
    """The rows of a batch, each a dict."""
    names = batch.schema.names
    return [dict(zip(names, x, strict=True)) for x in zip(*map(_values, batch.columns), strict=True)]


def _each(df: DataFrame, schema: str, types: list[pa.DataType], f: Callable[[dict], tuple]) -> DataFrame:
    """Apply ``f`` to each row (a dict) in Arrow batches."""
    names = [x.split(" ", 1)[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                out = [f(r) for r in _rows(b.slice(at, 1000))]
                cols = list(zip(*out, strict=True)) if out else [[] for _ in types]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, types, strict=True)], names=names)

    return df.mapInArrow(run, schema)


def _explode_found(df: DataFrame) -> DataFrame:
    return df.filter(F.size("found") > 0).select("file_ord", F.explode("found").alias("f")).select("file_ord", "f.pass", "f.pos", "f.kind", "f.key", "f.value")


def _parts(spark: SparkSession) -> int:
    """How many partitions texts are joined in: coalesced by size, few tasks would rewrite many texts."""
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _own_tokens(found: DataFrame, pii_map: DataFrame, parts: int) -> DataFrame:
    """Each document's tokens, partitioned by its number."""
    known = found.select("file_ord", "kind", "key").distinct().join(pii_map.select("kind", "key", "token"), ["kind", "key"])
    return known.repartition(parts, "file_ord").groupBy("file_ord").agg(F.collect_list(F.struct("kind", "key", "token")).alias("tokens"))


def _with_tokens(df: DataFrame, found: DataFrame, pii_map: DataFrame) -> DataFrame:
    """Add each document's own tokens; documents without values are not shuffled.

    Where no document holds any, nothing is joined: a join with an empty side leaves its other
    side's stage behind, which would read on after its table is deleted.
    """
    if found.isEmpty():
        return df.withColumn("tokens", F.lit(None).cast("array<struct<kind:string,key:string,token:string>>"))
    parts = _parts(df.sparkSession)
    some = df.filter(F.size("found") > 0).repartition(parts, "file_ord").join(_own_tokens(found, pii_map, parts), "file_ord", "left")
    none = df.filter(F.size("found") == 0).withColumn("tokens", F.lit(None).cast(some.schema["tokens"].dataType))
    return some.unionByName(none)


def _with_dictionary(df: DataFrame, entries: DataFrame, options: Options, found: DataFrame | None = None, pii_map: DataFrame | None = None):
    """The dictionary as a broadcast, or as a column of each document's candidates.

    With ``found`` and ``pii_map``, documents' own tokens are added too; a joined dictionary
    meets them first, so that texts are shuffled once.
    """
    rows = entries.select("kind", "key", "token", "file_ord", "pass", "pos")
    small = rows.limit(options.broadcast_entries + 1).count() <= options.broadcast_entries
    if small:
        # longest first, then first seen: documents need not sort it again
        listed = rows.toArrow()
        listed = listed.append_column("size", pc.utf8_length(listed["key"])).sort_by([("size", "descending"), *((c, "ascending") for c in ("file_ord", "pass", "pos", "key"))])
        shared = df.sparkSession.sparkContext.broadcast(P.Dictionary(listed.select(["kind", "key", "token", "file_ord"])))
        df = df if found is None else _with_tokens(df, found, pii_map)
        return df.withColumn("entries", F.lit(None).cast("array<struct<kind:string,key:string,token:string,file_ord:bigint,pass:int,pos:bigint>>")), shared
    # the same rule as in a broadcast dictionary: a key can only occur where all its units do, and its rarest finds it
    units = _each(df.select("file_ord", "text"), "doc long, units array<long>", [pa.int64(), pa.list_(pa.int64())], lambda r: (r["file_ord"], [*P.units_of(r["text"])]))
    units = units.select("doc", F.explode("units").alias("unit"))
    keys = cut(_each(rows.select("key").distinct(), "key string, units array<long>", [pa.string(), pa.list_(pa.int64())], lambda r: (r["key"], P.units_of_key(r["key"]))))
    each = keys.select("key", F.explode("units").alias("unit"))
    rarest = each.join(each.groupBy("unit").agg(F.count("*").alias("n")), "unit").groupBy("key").agg(F.min(F.struct("n", "unit"))["unit"].alias("unit"))
    keyed = rows.join(rarest, "key")
    visible = F.lit(True) if options.visibility == "global" else F.col("file_ord") <= F.col("doc")
    entry = F.struct("kind", "key", "token", "file_ord", "pass", "pos")
    parts = _parts(df.sparkSession)
    near = units.join(keyed, "unit").filter(visible).select(F.col("doc").alias("__doc"), entry.alias("entry"))
    near = near.repartition(parts, "__doc").groupBy("__doc").agg(F.collect_list("entry").alias("entries")).withColumnRenamed("__doc", "file_ord")
    if found is not None:
        near = near.join(_own_tokens(found, pii_map, parts), "file_ord", "full")
    return df.repartition(parts, "file_ord").join(near, "file_ord", "left"), None


def scrub(documents: DataFrame, pii_map: DataFrame | None = None, options: Options = Options(), ord_col: str = "file_ord", text_col: str = "text") -> Scrubbed:
    """Replace personal values in ``text_col``, documents taken in the order of ``ord_col``.

    A null text is treated as empty. Rows that share an order number are one after the
    other in no fixed order, so numbers should be distinct.
    """
    spark = documents.sparkSession
    allow, fields = frozenset(a.lower() for a in options.allowlist), options.fields
    secret = (options.secret or os.urandom(32)) if options.irreversible else None
    docs = spread(documents.select(F.col(ord_col).cast("long").alias("file_ord"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), "file_ord")
    known = cut(pii_map) if pii_map is not None else A.empty_map(spark)

    # 1. addresses, and the names beside them; a text without addresses goes on to 2 at once
    def find_addresses(r: dict) -> tuple:
        notes = _Notes()
        text = P.address_passes(r["text"], allow, notes.give, _quiet)
        if any(n["kind"] == "email" for n in notes.rows):
            return r["file_ord"], r["text"], notes.rows, None
        return r["file_ord"], r["text"], notes.rows, note_accounts(r, text, notes)

    # 2. accounts and names
    def find_accounts(r: dict) -> tuple:
        tokens, notes = _Tokens(r["tokens"]), _Notes()
        names = [n for n in r["found"] if n["kind"] == "person"]
        notes.rows += [{**n, "pos": i} for i, n in enumerate(names)]

        def give(no: int, kind: str, value: str) -> str:
            return tokens.give(no, kind, value) if kind == "email" else P.STAND_IN[kind]

        status = note_accounts(r, P.address_passes(r["text"], allow, give, _quiet), notes)
        emails = [e for e in r["found"] if e["kind"] == "email"]
        return r["file_ord"], r["text"], emails + notes.rows, status

    def note_accounts(r: dict, text: str, notes: _Notes) -> str:
        """Note what ``text``, the row's with its addresses replaced, and the row's own hold; the recogniser's status."""
        P.account_passes(text, allow, notes.give, _quiet)
        status = "off"
        if options.harvest_names:
            for n in t.harvest(r["text"], allow, fields.labels, fields.xml_tags, fields.json_keys, fields.csv_headers, options.single_token_names):
                P.person_token(notes.give, P.HARVEST, n)
        if options.recognise:
            status, found = recognised_names(r["text"], allow, options.ner_config)
            for n in found:
                P.person_token(notes.give, P.RECOGNISED, n)
        return status

    base, base_ddl = [pa.int64(), pa.string(), _FOUND, pa.string()], f"file_ord long, text string, found {_FOUND_DDL}, ner_status string"
    first = written(_each(docs, base_ddl, base, find_addresses))
    before, second, waiting = [first], first, first.filter("ner_status is null")
    found1 = _explode_found(waiting).filter("kind = 'email'")
    if not waiting.isEmpty():
        known = cut(A.allocate(found1, known, secret))
        before.append(written(_each(_with_tokens(waiting, found1, known), base_ddl, base, find_accounts)))
        second = first.filter("ner_status is not null").unionByName(before[-1])
    found2 = _explode_found(second)
    if options.scrub_orgs and options.orgs:
        rows = [(-1, P.ORGS, i, "org", o, o) for i, o in enumerate(options.orgs) if o.lower() not in allow]
        grown = found2.unionByName(spark.createDataFrame(rows, A.FOUND))
    else:
        grown = found2
    if not grown.isEmpty():
        known = cut(A.allocate(grown, known, secret))
    if options.expand_name_parts and not known.filter("kind = 'person'").isEmpty():
        known = cut(A.expand_names(known))

    # 3. rewriting by tokens and dictionary
    joined, shared = _with_dictionary(second, known.filter("kind in ('person', 'org', 'username')"), options, found2, known)

    def rewrite(r: dict) -> tuple:
        tokens, hits = _Tokens(r["tokens"]), _Hits()
        text = P.address_passes(r["text"], allow, tokens.give, hits.log)
        text = P.account_passes(text, allow, tokens.give, hits.log)
        if shared is not None:
            entries = shared.value.near(r["text"], None if options.visibility == "global" else r["file_ord"])
        else:
            own = sorted(r["entries"] or [], key=lambda e: (-len(e["key"]), e["file_ord"], e["pass"], e["pos"], e["key"]))
            entries = [(e["kind"], e["key"], e["token"]) for e in own]
        if not options.scrub_orgs:
            entries = [e for e in entries if e[0] != "org"]
        text = P.dictionary_passes(text, entries, allow, hits.log)
        return r["file_ord"], r["text"], text, hits.rows, r["ner_status"]

    state_ddl = f"file_ord long, original string, text string, hits {_HITS_DDL}, ner_status string"
    state_types = [pa.int64(), pa.string(), pa.string(), _HITS, pa.string()]

    # 4. values found by their form; each barrier rewrites by the one before, then finds, in one pass
    # 5. what is left, counted as soon as the last barrier finds nothing to rewrite
    def leftovers(text: str) -> list[dict]:
        return [{"kind": k, "value": v} for k, v in t.residuals(text, allow, options.nl_id, options.p2)]

    kinds = options.kinds()
    state, put = joined, rewrite
    own_barrier = [k for k in kinds if k in ("ip", "cert", "path", "cmd", "machine")]
    groups = [[k] for k in own_barrier] + [[k for k in kinds if k not in own_barrier]]
    for no, group in enumerate(groups, 1):

        def find_values(r: dict, group: list[str] = group, put: Callable[[dict], tuple] = put, last: bool = no == len(groups)) -> tuple:
            row, notes = put(r), _Notes()
            text = row[2]
            for kind in group:
                text = P.value_pass(text, kind, allow, notes.give, _quiet)
            return *row, notes.rows, leftovers(row[2]) if last and not notes.rows else None

        def put_values(r: dict, group: list[str] = group) -> tuple:
            tokens, hits, text = _Tokens(r["tokens"]), _Hits(r["hits"]), r["text"]
            for kind in group if r["found"] else ():
                text = P.value_pass(text, kind, allow, tokens.give, hits.log)
            return r["file_ord"], r["original"], text, hits.rows, r["ner_status"]

        noted = written(_each(state, f"{state_ddl}, found {_FOUND_DDL}, residual {_PAIRS_DDL}", [*state_types, _FOUND, _PAIRS], find_values))
        for table in before:
            drop_written(table)
        before, found, put = [noted], _explode_found(noted), put_values
        none = found.isEmpty()
        if not none:
            known = cut(A.allocate(found, known, secret))
        state = _with_tokens(noted, found, known)

    def put_last(r: dict) -> tuple:
        row = put_values(r)
        return *row, leftovers(row[2])

    final = noted.drop("found")
    if not none:
        rest = written(_each(state.filter("residual is null"), f"{state_ddl}, residual {_PAIRS_DDL}", [*state_types, _PAIRS], put_last))
        final = final.filter("residual is not null")
        if final.isEmpty():
            drop_written(noted)
            final = rest
        else:
            final = final.unionByName(rest)
    hits = final.select("file_ord", F.explode("hits").alias("h")).select("file_ord", "h.pass", "h.seq", "h.kind", "h.original", "h.replacement")
    rest = final.select("file_ord", F.explode("residual").alias("r")).select("file_ord", "r.kind", "r.value")
    return Scrubbed(final.select("file_ord", "original", "text", "ner_status"), hits, rest, known)


def scrub_text(spark, text: str, pii_map: DataFrame | None = None, options: Options = Options()) -> Scrubbed:
    """One text, as a table of one document."""
    return scrub(spark.createDataFrame([(0, text)], "file_ord long, text string"), pii_map, options)


__all__ = ["Scrubbed", "scrub", "scrub_text"]
