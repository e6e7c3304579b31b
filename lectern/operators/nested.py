"""Deeply nested records as related flat tables: one depth-first pass, tagged rows, a table per tag.

The visitor walks each JSON record once and emits, for every item it meets, (tag, record id, primary key, parent key, positions, payload).
Which paths are lists, which are single objects, and how keys are spelled, is declared by ``Spec``; nothing of it is in the visitor.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


@dataclass(frozen=True)
class Node:
    """A child table: the key it has in its parent, the other spellings of that key, and its own children.

    one: the item is a single object, not a list. text_key: where a plain string in place of an object goes. leaf: items are plain values.
    own: the item counts by these keys alone (evidence: page, quote). A node with table False is only a step on the way.
    """

    key: str
    aliases: tuple[str, ...] = ()
    one: bool = False
    leaf: bool = False
    table: bool = True
    text_key: str = "name"
    renamed: tuple[tuple[str, str], ...] = ()
    children: tuple[Node, ...] = ()


@dataclass(frozen=True)
class Spec:
    """What the visitor looks for: the children of a record, and the keys of outer objects that only wrap it."""

    children: tuple[Node, ...]
    wrappers: tuple[str, ...] = ()
    fenced: bool = False
    lower_keys: bool = field(default=True)


TAGGED = "tag string, record_id bigint, pk string, parent_pk string, parent_pos int, pos int, present boolean, payload string"
_FENCE = re.compile(r"^\s*```[^\n`]*\n?(.*?)\n?\s*(?:```)?\s*$", re.S)


def filled(x: object) -> bool:
    """Neither null nor blank; a list or object is filled if something in it is."""
    if x is None:
        return False
    if isinstance(x, str):
        return bool(x.strip())
    if isinstance(x, dict):
        return any(map(filled, x.values()))
    if isinstance(x, list):
        return any(map(filled, x))
    return True


def _parse(text: str | None, spec: Spec) -> object:
    if text is None:
        return None
    if spec.fenced and text.lstrip().startswith("```"):
        text = _FENCE.sub(r"\1", text)
    try:
        return json.loads(text)
    except (ValueError, RecursionError):
        return None


def _lower(o: dict, renamed: tuple[tuple[str, str], ...] = ()) -> dict:
    """Keys in lower case and by their main spelling; of two spellings of one key the first that is filled stays."""
    names, out = dict(renamed), {}
    for k, v in o.items():
        k = k.strip().lower()
        k = names.get(k, k)
        if k not in out or not filled(out[k]):
            out[k] = v
    return out


def _visit(node: Node, holder: dict, record: int, path: str, parent_pk: str, parent_pos: int) -> Iterator[tuple]:
    value = None
    for k in (node.key, *node.aliases):
        if k in holder and (value is None or not filled(value)) and holder[k] is not None:
            value = holder[k]
    if value is None:
        return
    path = f"{path}.{node.key}" if path else node.key
    own = {c.key for c in node.children} | {a for c in node.children for a in c.aliases} | {"evidence", "projects"}
    for pos, item in enumerate(value if isinstance(value, list) else [value], 1):
        if node.one and pos > 1:
            break
        if item is None:
            continue
        if isinstance(item, dict):
            item = _lower(item, node.renamed)
            present = any(filled(v) for k, v in item.items() if k not in own) if node.table else True
        else:
            present = filled(item)
            if not node.leaf:
                item = {node.text_key: item}
        pk = f"{parent_pk}/{node.key}:{pos}"
        if node.table:
            plain = item if node.leaf and not isinstance(item, dict) else {k: v for k, v in item.items() if k not in own}
            yield path, record, pk, parent_pk, parent_pos, pos, present, json.dumps(plain, ensure_ascii=False)
        if present and isinstance(item, dict):
            for c in node.children:
                yield from _visit(c, item, record, path, pk, pos if node.table else 0)


def visit(record: int, text: str | None, spec: Spec) -> Iterator[tuple]:
    """The tagged rows of one record, depth first. Text that isn't a JSON object has none."""
    o = _parse(text, spec)
    if not isinstance(o, dict):
        return
    o = _lower(o)
    while (inner := next((o[w] for w in spec.wrappers if isinstance(o.get(w), dict)), None)) is not None:
        o = _lower(inner)
    for node in spec.children:
        yield from _visit(node, o, record, "", str(record), 0)


def emit(df: DataFrame, record_id: str, record: Column, spec: Spec) -> DataFrame:
    """Tagged rows of every record: ``TAGGED``. record: a JSON string, or a struct (written as JSON inside the JVM).

    One pass, no shuffle; a record's rows stay in its partition. Items that are null emit nothing, but count in the position of later ones;
    blank items come with present = false. Empty tables give an empty result; records with a null id or null text emit nothing; repeated records
    emit repeated rows. Other columns of ``df`` aren't read, so clashing names don't matter.
    """
    kind = df.select(record.alias("_r")).schema[0].dataType
    text = F.to_json(record) if isinstance(kind, StructType) else record
    out = pa.schema([("tag", pa.string()), ("record_id", pa.int64()), ("pk", pa.string()), ("parent_pk", pa.string()), ("parent_pos", pa.int32()), ("pos", pa.int32()), ("present", pa.bool_()), ("payload", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [r for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for r in visit(i, t, spec)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(out), out, strict=True)], schema=out)

    return df.select(F.col(record_id).cast("long").alias("_i"), text.alias("_t")).where("_i is not null and _t is not null").mapInArrow(run, TAGGED)


def write_tables(tagged: DataFrame, path: str) -> None:
    """Write the tagged rows once, a folder per tag."""
    tagged.write.mode("overwrite").partitionBy("tag").parquet(path)


def read_table(spark, path: str, tag: str, schema: str) -> DataFrame:
    """The flat table of one tag: keys, positions, and the payload under ``schema`` (a DDL string); only that tag's folder is read."""
    rows = spark.read.parquet(path).where(F.col("tag") == tag)
    keys = ["record_id", "pk", "parent_pk", "parent_pos", "pos", "present"]
    if schema.strip().lower() in ("string", "value string"):
        return rows.select(*keys, F.from_json(F.concat(F.lit('{"value":'), "payload", F.lit("}")), "value string").alias("_p")).select(*keys, "_p.*")
    return rows.select(*keys, F.from_json("payload", schema).alias("_p")).select(*keys, "_p.*")
