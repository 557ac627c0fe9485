"""A feed of inserts, updates, key changes and deletes applied in order, as composed patches (problem 5).

A range of the ordered feed of one table is a function from the table before to the table after. It is kept as one
entry for each key that it touches: the key ends absent, or holds a row that comes from a source key (or is new) and is
patched. Composition of two such functions is associative, so

1. the feed is range-partitioned by table and order, and each chunk is folded into its entries where it lies, so even
   a single hot key is cut into chunks;
2. the entries of a key that no change moves and that nothing moves to depend on no other key, so all chunks of it are
   composed in one shuffle by (table, key), of at most one row a chunk;
3. for the keys that moves tie together, neighbouring chunks of a table are composed pairwise in a tree, each level one
   shuffle by (table, chunk pair, key) with at most three rows in a group;
4. the last function is applied to the base table.

Rules: a null old key inserts, a null new key deletes, otherwise the row at the old key moves to the new one. A row that
arrives at an occupied key replaces what was there. A change of a row that is not there makes a new one. A value that a
change does not set keeps its earlier content, null in a new row. A change with both keys null does nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialize

#: Separators of a layout: between its columns, and between a column's name, its cell and the cell of its flag.
_NEXT, _PART = "\x1e", "\x1f"
_ENTRY = "key array<string>, alive boolean, src array<string>, patch map<string,string>, version bigint"
_SCHEMA = f"tab string, chunk int, {_ENTRY}"
_ARROW = pa.schema(
    [
        ("tab", pa.string()), ("chunk", pa.int32()), ("key", pa.list_(pa.string())), ("alive", pa.bool_()),
        ("src", pa.list_(pa.string())), ("patch", pa.map_(pa.string(), pa.string())), ("version", pa.int64()),
    ]
)


class Chunk:
    """The function that a range of one table's changes makes: key -> None (absent) or [src, patch, version]."""

    def __init__(self):
        self.at: dict[tuple, list | None] = {}

    def change(self, old: tuple | None, new: tuple | None, patch: dict, version: int) -> None:
        if old is None:
            row = [None, {}, version]
        else:
            row = self.at[old] if old in self.at else [old, {}, version]
            if row is None:
                row = [None, {}, version]
            self.at[old] = None
        if new is not None:
            row[1].update(patch)
            row[2] = version
            self.at[new] = row


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = TaskContext.get().partitionId()
    tab, before, chunk = None, None, Chunk()

    def out() -> Iterator[pa.RecordBatch]:
        items = list(chunk.at.items())
        for i in range(0, len(items), 20_000):
            part = items[i : i + 20_000]
            rows = [r for _, r in part]
            srcs, patches = [r[0] if r else None for r in rows], [r[1] if r else {} for r in rows]
            ends = np.cumsum([0, *map(len, patches)]).astype(np.int32)
            patch = pa.MapArray.from_arrays(pa.array(ends), pa.array([k for p in patches for k in p], pa.string()), pa.array([v for p in patches for v in p.values()], pa.string()))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([tab] * len(part), pa.string()), pa.array(np.full(len(part), n, np.int32)), _lists([k for k, _ in part]), pa.array([r is not None for r in rows]),
                    _lists(srcs), patch.cast(_ARROW.field("patch").type), pa.array([r[2] if r else None for r in rows], pa.int64()),
                ], schema=_ARROW
            )

    layouts: dict[str, list[tuple[str, int, int]]] = {}
    for b in batches:
        tabs, versions, origins, rows, shapes = (_values(b.column(k)) for k in (0, 1, 2, 3, 6))
        (olds, news), (flat, begin) = (_tuples(b.column(k)) for k in (4, 5)), _flat(b.column(7))
        for k, (t, v, o, r, old, new, shape) in enumerate(zip(tabs, versions, origins, rows, olds, news, shapes)):
            if t != tab:
                yield from out()
                tab, before, chunk = t, None, Chunk()
            if (v, o, r) == before:
                continue  # the same change again
            before = (v, o, r)
            if old is None and new is None:
                continue
            if shape not in layouts:
                parts = (x.split(_PART) for x in (shape or "").split(_NEXT) if x)
                layouts[shape] = [(name, int(at), int(flag)) for name, at, flag in parts]
            patch = {}
            if new is not None:
                first = begin[k]
                given = begin[k + 1] - first
                for name, at, flag in layouts[shape]:
                    if flag < 0 or flag < given and flat[first + flag] is not None and flat[first + flag].lower() == "true":
                        patch[name] = flat[first + at] if at < given else None
            chunk.change(old, new, patch, v)
    yield from out()


def _values(column: pa.Array) -> list:
    """A column's values; the faster way by numpy has no whole numbers beside nulls."""
    return column.to_pylist() if column.null_count else column.to_numpy(zero_copy_only=False).tolist()


def _flat(lists: pa.ListArray) -> tuple[list, list[int]]:
    """All values of a column of lists, and where each list begins; a null list has none."""
    return lists.values.to_numpy(zero_copy_only=False).tolist(), lists.offsets.to_pylist()


def _tuples(lists: pa.ListArray) -> list[tuple | None]:
    """A column of lists as tuples."""
    (flat, begin), valid = _flat(lists), lists.is_valid().to_numpy(zero_copy_only=False).tolist()
    return [tuple(flat[i:j]) if ok else None for i, j, ok in zip(begin, begin[1:], valid)]


def _lists(tuples: list[tuple | None]) -> pa.ListArray:
    """Tuples as a column of lists."""
    ends = np.cumsum([0, *(len(t) if t is not None else 0 for t in tuples)]).astype(np.int32)
    flat = pa.array([x for t in tuples if t is not None for x in t], pa.string())
    return pa.ListArray.from_arrays(pa.array(ends), flat, mask=pa.array([t is None for t in tuples]))


def overlay(lower, upper):
    """The map lower with the entries of upper over it."""
    return F.map_concat(F.map_filter(lower, lambda k, _: ~F.array_contains(F.map_keys(upper), k)), upper)


def _compose_level(entries: DataFrame) -> DataFrame:
    """Compose chunks 2k and 2k + 1 of each table into chunk k; width is the number of chunks of the table."""
    entry = F.struct("key", "alive", "src", "patch", "version")
    right = (F.col("chunk") % 2) == 1
    none = F.when(F.lit(False), entry)
    at_key = F.struct(F.col("key").alias("at"), F.when(~right, entry).alias("lower"), right.alias("over"), F.when(right & F.col("src").isNull(), entry).alias("own"), none.alias("moved"))
    at_src = F.struct(F.col("src").alias("at"), none.alias("lower"), F.lit(False).alias("over"), none.alias("own"), entry.alias("moved"))
    sent = entries.select("tab", F.ceil(F.col("width") / 2).cast("int").alias("width"), F.floor(F.col("chunk") / 2).cast("int").alias("chunk"), F.explode(F.when(right & F.col("src").isNotNull(), F.array(at_key, at_src)).otherwise(F.array(at_key))).alias("s"))
    met = sent.groupBy("tab", "width", "chunk", F.col("s.at").alias("at")).agg(
        F.first("s.lower", True).alias("lower"), F.max("s.over").alias("over"), F.first("s.own", True).alias("own"), F.first("s.moved", True).alias("moved")
    )
    low, up = F.col("lower"), F.col("moved")
    through = F.struct(
        up["key"].alias("key"), up["alive"].alias("alive"),
        F.when(low.isNull(), up["src"]).otherwise(low["src"]).alias("src"),
        F.when(low.isNull() | ~low["alive"], up["patch"]).otherwise(overlay(low["patch"], up["patch"])).alias("patch"),
        up["version"].alias("version"),
    )
    stays = F.when(low.isNotNull() & ~F.col("over"), low)
    kept = F.array_compact(F.array(stays, F.when(up.isNotNull(), through), F.col("own")))
    return met.select("tab", "width", "chunk", F.explode(kept).alias("e")).select("tab", "width", "chunk", "e.*")


def _compose_static(entries: DataFrame) -> DataFrame:
    """The entries of keys that no move ties to others, over all chunks of a table: one list a key, composed in order."""
    entry = F.struct("chunk", "alive", "src", "patch", "version")
    moves = F.coalesce(F.col("src") != F.col("key"), F.lit(False))
    own = F.struct(F.col("key").alias("at"), entry.alias("e"), moves.alias("tied"))
    other = F.struct(F.col("src").alias("at"), F.when(F.lit(False), entry).alias("e"), F.lit(True).alias("tied"))
    sent = entries.select("tab", "width", F.explode(F.when(moves, F.array(own, other)).otherwise(F.array(own))).alias("s"))
    return sent.groupBy("tab", "width", F.col("s.at").alias("key")).agg(F.collect_list("s.e").alias("es"), F.max("s.tied").alias("tied"))


def _in_order(es):
    """A key's own entries, composed: a later one that goes on from the key itself is laid over the one before."""

    def step(a, e):
        patch = F.when(a["alive"], overlay(a["patch"], e["patch"])).otherwise(e["patch"])
        on = F.struct(e["chunk"].alias("chunk"), e["alive"].alias("alive"), a["src"].alias("src"), patch.alias("patch"), e["version"].alias("version"))
        return F.when(e["src"].isNull(), e).otherwise(on)

    # In order of their chunks; maps have no order, so the entries are told apart by the chunk alone.
    chunks = F.array_sort(F.transform(es, lambda e: e["chunk"]))
    ordered = F.transform(chunks, lambda c: F.filter(es, lambda e: e["chunk"] == c)[0])
    return F.when(F.size(es) == 1, es[0]).otherwise(F.aggregate(F.slice(ordered, 2, F.size(es)), ordered[0], step))


def layout_of(names: list[str], flags: dict[str, int] | None = None) -> str:
    """The layout of cells that hold the columns names in order; flags: the cell that says whether a column is set."""
    return _NEXT.join(f"{name}{_PART}{k}{_PART}{(flags or {}).get(name, -1)}" for k, name in enumerate(names))


def ordered(changes: DataFrame, chunks: int | None = None) -> DataFrame:
    """changes in ranges of (tab, version, origin, row_no), sorted within each; done early, wide columns can be made after it."""
    n = chunks or int(changes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["tab", "version", "origin", "row_no"]
    return changes.where("tab IS NOT NULL AND version IS NOT NULL").repartitionByRange(n, *order).sortWithinPartitions(*order)


def compose(changes: DataFrame, chunks: int | None = None, is_ordered: bool = False) -> DataFrame:
    """The whole feed as one function: tab, key, alive, src, patch, version (of the last change), one row per key.

    changes: tab, version, origin, row_no, old_key, new_key (arrays of text, null for no key), and what the change sets:
    layout and cells (see layout_of; a column is set if it has no flag or its flag's cell is 'true'), or names and values
    (arrays). They are applied by version, then row_no; origin tells apart changes of equal version and row_no, which never
    touch the same key. Rows equal in tab, version, origin and row_no are one change. Rows with a null tab or version are not
    applied. No changes give an empty result. is_ordered: changes come from ordered().
    """
    if "layout" not in changes.columns:
        named = F.transform("names", lambda n, k: F.concat(n, F.lit(_PART), k.cast("string"), F.lit(f"{_PART}-1")))
        changes = changes.withColumns({"layout": F.array_join(named, _NEXT), "cells": F.col("values")})
    feed = changes.select("tab", "version", "origin", "row_no", "old_key", "new_key", "layout", "cells")
    folded = (feed if is_ordered else ordered(feed, chunks)).mapInArrow(_fold, _SCHEMA)
    folded = materialize(folded, "folded")
    # A table in more than one chunk crosses a border between chunks, so there are fewer of these than chunks.
    spans = folded.groupBy("tab").agg(F.min("chunk").alias("_lo"), F.max("chunk").alias("_hi")).where("_lo < _hi")
    spans = F.broadcast(spans.withColumnRenamed("tab", "_tab"))
    placed = folded.join(spans, F.col("tab") == F.col("_tab"), "left").withColumn("width", F.coalesce(F.col("_hi") - F.col("_lo") + 1, F.lit(1)))
    placed = placed.withColumn("chunk", F.coalesce(F.col("chunk") - F.col("_lo"), F.lit(0))).drop("_tab", "_lo", "_hi")
    # A table leaves the tree as soon as it is one chunk, so later levels have only the largest tables' entries.
    done, wide = placed.where("width = 1").drop("chunk", "width"), placed.where("width > 1")
    width = folded.groupBy("tab").agg((F.max("chunk") - F.min("chunk") + 1).alias("w")).agg(F.max("w")).head()[0] or 1
    if width == 1:
        return done
    split = materialize(_compose_static(wide), "split")
    alone = split.where("NOT tied").select("tab", "key", _in_order(F.col("es")).alias("e"))
    done = done.unionByName(alone.select("tab", "key", "e.alive", "e.src", "e.patch", "e.version"))
    tree = split.where("tied").select("tab", "width", "key", F.explode("es").alias("e")).select("tab", "width", "key", "e.*")
    while width > 1:
        level = materialize(_compose_level(tree), "tree")
        done = done.unionByName(level.where("width = 1").drop("chunk", "width"))
        tree = level.where("width > 1")
        width = -(-width // 2)
    return done


def apply_patches(function: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """The rows after the feed: tab, key, values (map), version.

    base: tab, key, values, version, with unique keys; without it the tables were empty. Base rows that the feed does
    not touch stay as they are.
    """
    alive = function.where("alive")
    if base is None:
        return alive.select("tab", "key", F.col("patch").alias("values"), "version")
    b = base.select(F.col("tab").alias("_tab"), F.col("key").alias("_key"), F.col("values").alias("_values"))
    moved = alive.join(b, (F.col("tab") == F.col("_tab")) & (F.col("src") == F.col("_key")), "left")
    moved = moved.select("tab", "key", F.when(F.col("_values").isNull(), F.col("patch")).otherwise(overlay(F.col("_values"), F.col("patch"))).alias("values"), "version")
    touched = function.select(F.col("tab").alias("_t"), F.col("key").alias("_k"))
    rest = base.join(touched, (F.col("tab") == F.col("_t")) & (F.col("key") == F.col("_k")), "left_anti")
    return rest.select("tab", "key", "values", "version").unionByName(moved)


def message_layouts(messages: DataFrame, keys: list[str]) -> DataFrame:
    """messages with layout, old_at and new_at in place of column_descriptors (role, name): where a row's cells belong.

    keys: the key columns, in order; old_at and new_at are the cells of OLD_PK and NEW_PK, null for one that is not there. A
    VALUE is set if its column has no CHANGED flag or the flag's cell is 'true'.
    """
    d = F.transform("column_descriptors", lambda x, k: F.struct(x["role"].alias("role"), x["name"].alias("name"), k.alias("k")))
    place = lambda role, name: F.get(F.filter("_d", lambda x: (x["role"] == role) & (x["name"] == name)), 0)["k"]
    value = lambda x: F.concat(x["name"], F.lit(_PART), x["k"].cast("string"), F.lit(_PART), F.coalesce(place("CHANGED", x["name"]), F.lit(-1)).cast("string"))
    layout = F.array_join(F.transform(F.filter("_d", lambda x: (x["role"] == "VALUE") & x["name"].isNotNull()), value), _NEXT)
    at = lambda role: F.array(*[place(role, n) for n in keys])
    return messages.withColumn("_d", d).withColumns({"layout": layout, "old_at": at("OLD_PK"), "new_at": at("NEW_PK")}).drop("_d", "column_descriptors")


def changes_of_messages(rows: DataFrame, keys: dict[str, str], chunks: int | None = None) -> DataFrame:
    """Ordered changes for compose: rows have tab, version, origin, row_no and cells, with layout, old_at and new_at of their message.

    A row with null or too few cells has nulls there. Other columns are not read.

    keys: name and type of each key column, in order; key cells are brought to one spelling through the type. A key
    is null if all its cells are.
    """
    rows = ordered(rows.select("tab", "version", "origin", "row_no", "layout", "old_at", "new_at", "cells"), chunks)

    def key(at: str):
        parts = [F.get("cells", F.col(at)[k]).try_cast(kind).cast("string") for k, kind in enumerate(keys.values())]
        return F.when(F.coalesce(*parts).isNotNull(), F.array(*parts))

    return rows.withColumns({"old_key": key("old_at"), "new_key": key("new_at")}).drop("old_at", "new_at")
