"""Arrow batches of decoded elements."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa

KINDS = ("node", "way", "relation")

_META = [("id", pa.int64()), ("version", pa.int32()), ("timestamp", pa.int64()), ("changeset", pa.int64()), ("uid", pa.int32()), ("user", pa.string())]
_OWN = {
    "node": [("lon", pa.int32()), ("lat", pa.int32())],
    "way": [("nds", pa.list_(pa.int64()))],
    "relation": [("members", pa.list_(pa.struct([("type", pa.string()), ("ref", pa.int64()), ("role", pa.string())])))],
}
_TAGS = ("tags", pa.map_(pa.string(), pa.string()))
SCHEMAS = {k: pa.schema([*_META, *own, _TAGS]) for k, own in _OWN.items()}
ANY = pa.schema([("kind", pa.string()), *_META, *(f for own in _OWN.values() for f in own), _TAGS])


def batch(kind: str, columns: Sequence) -> pa.RecordBatch:
    """Columns (arrays or sequences) of one kind, in the order of its schema."""
    schema = SCHEMAS[kind]
    dicts = lambda c: [[{"type": t, "ref": r, "role": x} for t, r, x in m] for m in c]
    cols = [c.cast(f.type) if isinstance(c, pa.Array) else pa.array(dicts(c) if f.name == "members" else c, f.type) for f, c in zip(schema, columns)]
    return pa.RecordBatch.from_arrays(cols, schema=schema)


def with_kind(kind: str, b: pa.RecordBatch) -> pa.RecordBatch:
    """The batch as rows of all kinds: its kind in front, null in the columns it lacks."""
    n = b.num_rows
    cols = [pa.array([kind] * n) if f.name == "kind" else b.column(f.name) if f.name in b.schema.names else pa.nulls(n, f.type) for f in ANY]
    return pa.RecordBatch.from_arrays(cols, schema=ANY)
