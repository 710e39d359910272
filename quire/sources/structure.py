"""The structure of files, read from their end.

One pass over a file yields its ending (where its last table of references is, of which form, and what the
trailer names) and the live definition of every object, packed ones too.  Words inside streams are never read as structure:
the trailer is found by the offset behind `startxref`, else between objects, else in the latest object of references.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.sources.locks import Lock, lock_of

BUDGET = 64 << 20
#: `startxref` is looked for in so many bytes at the end; so many earlier sections are followed for a root.
LAST, EARLIER = 65_536, 1_024
_TOKEN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|%[^\r\n]*|<<|>>|\[|\]|<[0-9A-Fa-f\s]*>|/[^\s()<>\[\]{}/%]*|[^\s()<>\[\]{}/%]+|\S", re.S)
_NAME = re.compile(rb"#([0-9A-Fa-f]{2})")
_HEAD = re.compile(rb"(?<![0-9])(\d{1,10})\s+(\d{1,5})\s+obj(?![A-Za-z])")
_REF = re.compile(rb"\s*(\d{1,10})\s+(\d{1,5})\s+R\s*\Z")
_TABLE = re.compile(rb"\s*xref(?![A-Za-z])(?:\s*\d+\s+\d+(?:\s+[nf](?![A-Za-z]))?)*\s*trailer(?![A-Za-z])")
_STREAM = re.compile(rb"\s*stream\r?\n")
#: Values of page tree nodes that a leaf may inherit, and those that are a node's own.
INHERITED, OWN = ("Resources", "MediaBox", "Rotate"), ("Contents", "Pages", "Kids")


def name_text(token: bytes) -> str:
    return _NAME.sub(lambda m: bytes([int(m[1], 16)]), token[1:]).decode("latin-1")


def spans(data: bytes, at: int = 0) -> tuple[dict[str, tuple[int, int]], int] | None:
    """Where the values of the dictionary that begins at `at` lie, and where it ends; None if it cannot be read to its end."""
    tokens = (m for m in _TOKEN.finditer(data, at) if not m[0].startswith(b"%"))
    first = next(tokens, None)
    if first is None or first[0] != b"<<":
        return None
    out: dict[str, tuple[int, int]] = {}
    key, begin, end, depth = None, None, None, 0
    for m in tokens:
        t = m[0]
        if depth == 0 and (t == b">>" or t.startswith(b"/") and key is not None and begin is not None):
            if key is not None:
                if begin is None:
                    return None
                out.setdefault(key, (begin, end))
            if t == b">>":
                return out, m.end()
            key, begin = name_text(t), None
        elif depth == 0 and key is None:
            if not t.startswith(b"/"):
                return None
            key = name_text(t)
        else:
            begin = m.start() if begin is None else begin
            end = m.end()
            depth += (t in (b"<<", b"[")) - (t in (b">>", b"]"))
    return None


def values(data: bytes, at: int = 0) -> dict[str, bytes] | None:
    """Keys and raw values of the dictionary that begins at `at`."""
    found = spans(data, at)
    return None if found is None else {k: data[b:e] for k, (b, e) in found[0].items()}


def ref_of(value: bytes | None) -> tuple[int, int] | None:
    m = _REF.match(value or b"")
    return (int(m[1]), int(m[2])) if m else None


def refs_of(value: bytes) -> list[tuple[int, int]]:
    """The references of an array: not those inside its strings, comments, dictionaries or arrays of its own."""
    out, pending, depth, bare = [], [], 0, not value.lstrip().startswith(b"[")
    for m in _TOKEN.finditer(value):
        t = m[0]
        if t.startswith(b"%"):
            pending = []
            continue
        if t in (b"[", b"<<"):
            depth, pending = depth + 1, []
        elif t in (b"]", b">>"):
            depth, pending = depth - 1, []
        elif depth == (0 if bare else 1):
            if t == b"R" and len(pending) >= 2:
                out.append((pending[-2], pending[-1]))
            pending = [*pending[-1:], int(t)] if re.fullmatch(rb"\d{1,12}", t) else []
    return out


def scan(data: bytes, most: int = 5_000_000) -> Iterator[tuple[int, int, int, int, int]]:
    """(number, generation, start, body start, body end) of the objects at the top level."""
    at, n = 0, 0
    while (m := _HEAD.search(data, at)) and n < most:
        end, stream = data.find(b"endobj", m.end()), data.find(b"stream", m.end())
        if 0 <= stream < (end if end >= 0 else len(data)):
            size = re.search(rb"/Length\s+(\d+)(?!\s+\d+\s+R)", data[m.end() : stream])
            skip = stream + 6 + int(size[1]) if size else stream + 6
            close = data.find(b"endstream", min(skip, len(data)))
            end = data.find(b"endobj", close if close >= 0 else m.end())
        end = len(data) if end < 0 else end
        yield int(m[1]), int(m[2]), m.start(), m.end(), end
        at, n = end + 6, n + 1


def _section(data: bytes, at: int) -> tuple[str, dict[str, bytes]] | None:
    """Form and trailer of the table of references at an offset."""
    if not 0 <= at < len(data):
        return None
    if m := _TABLE.match(data, at):
        found = values(data, m.end())
        return None if found is None else ("table", found)
    if m := re.compile(rb"\s*\d{1,10}\s+\d{1,5}\s+obj(?![A-Za-z])").match(data, at):
        found = values(data, m.end())
        if found is not None and found.get("Type") == b"/XRef":
            return "stream", found
    return None


def ending(data: bytes, tops: list[tuple[int, int, int, int, int]]) -> dict | None:
    """startxref, form, root (number, generation), size, and the raw Encrypt and ID; None without a way to the root."""
    at = data.rfind(b"startxref", max(0, len(data) - LAST))
    m = re.compile(rb"startxref\s+(\d{1,18})(?!\d)").match(data, at) if at >= 0 else None
    if not m:
        return None
    first = int(m[1])
    found, seen, place, form = {}, set(), first, None
    while "Root" not in found and place is not None and place not in seen and len(seen) < EARLIER:
        seen.add(place)
        section = _section(data, place)
        if section is None:
            break
        form = form or section[0]
        found = {**section[1], **found}
        prev = section[1].get("Prev", b"")
        place = int(prev) if re.fullmatch(rb"\d{1,18}", prev) else None
    if "Root" not in found:
        starts = [t[2] for t in tops]
        for m in reversed(list(re.finditer(rb"(?<![A-Za-z])trailer\s*(?=<<)", data))):
            k = bisect.bisect_right(starts, m.start()) - 1
            if (k < 0 or m.start() >= tops[k][4]) and "Root" in (section := values(data, m.end()) or {}):
                found, form = {**section, **found}, form or "table"
                break
    if "Root" not in found:
        for kind in (b"/XRef", b"/Catalog"):
            for obj, gen, _, begin, _ in reversed(tops):
                d = values(data, begin)
                if d is not None and d.get("Type") == kind and (kind == b"/Catalog" or "Root" in d):
                    found, form = d if kind == b"/XRef" else {"Root": b"%d %d R" % (obj, gen)}, form or ("stream" if kind == b"/XRef" else "table")
                    break
            if "Root" in found:
                break
    root = ref_of(found.get("Root"))
    if root is None:
        return None
    size = found.get("Size", b"")
    return {"startxref": first, "form": form, "root": root, "size": int(size) if re.fullmatch(rb"\d{1,10}", size) else 1, "Encrypt": found.get("Encrypt"), "ID": found.get("ID")}


def stream_bytes(data: bytes, fields: dict[str, bytes], lock: Lock | None, obj: int, gen: int, most: int = BUDGET) -> bytes | None:
    """A stream's plain bytes; None where its filter is another than Flate or its bytes are broken."""
    kind = fields.get("Filter")
    if kind not in (None, b"/FlateDecode", b"[/FlateDecode]", b"[ /FlateDecode ]") or "DecodeParms" in fields:
        return None
    data = lock.opened(data, obj, gen) if lock else data
    if kind is None:
        return data[:most]
    try:
        return zlib.decompressobj().decompress(data, most)
    except zlib.error:
        return None


def live(data: bytes, tops: list, lock: Lock | None, budget: int = BUDGET) -> dict[int, tuple]:
    """number: (position, generation, dictionary, stream start, stream end, own): the latest definition of each object.

    Objects packed in streams stand at their stream's position; streams are unpacked newest first until
    what they inflate to reaches the budget.
    """
    out: dict[int, tuple] = {}
    streams = []
    for obj, gen, start, begin, end in tops:
        found = spans(data, begin)
        if found is None:
            out[obj] = (start, gen, data[begin:end].strip(), None, None, False)
            continue
        fields = {k: data[b:e] for k, (b, e) in found[0].items()}
        m = _STREAM.match(data, found[1], end)
        stop = None
        if m:
            size = fields.get("Length", b"")
            stop = m.end() + int(size) if re.fullmatch(rb"\d{1,12}", size) else None
            close = data.rfind(b"endstream", m.end(), end)
            stop = stop if stop is not None and stop <= end else len(data[: close if close >= 0 else end].rstrip(b"\r\n"))
            if fields.get("Type") == b"/ObjStm":
                streams.append((start, obj, gen, fields, m.end(), stop))
        out[obj] = (start, gen, data[begin : found[1]].strip(), m.end() if m else None, stop, True)
    left = budget
    for start, obj, gen, fields, begin, stop in reversed(streams):
        plain = stream_bytes(data[begin:stop], fields, lock, obj, gen, left + 1)
        if plain is None:
            continue
        left -= len(plain)
        if left < 0:
            break
        try:
            n, first = int(fields["N"]), int(fields["First"])
            numbers = [int(x) for x in plain[:first].split()[: 2 * n]]
        except (KeyError, ValueError):
            continue
        pairs = sorted(zip(numbers[1::2], numbers[::2]))
        for (offset, inner), close in zip(pairs, [*(p[0] for p in pairs[1:]), len(plain) - first]):
            if inner not in out or out[inner][0] < start:
                part = plain[first + offset : first + close].strip()
                out[inner] = (start, 0, part, None, None, spans(part) is not None)
    return out


ENDING = "state string, startxref long, form string, root long, root_gen long, size long, length long, largest long, encrypted boolean"
PARSED = f"obj long, gen long, start long, kind string, head binary, stream_start long, stream_end long, plain binary, kids array<long>, node map<string,binary>, ending struct<{', '.join(x.replace(' ', ':') for x in ENDING.split(', '))}>"
_ENDING = [x.split() for x in ENDING.split(", ")]
_KIND = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}


def _rows(data: bytes | None, budget: int, contents: bool) -> list[tuple]:
    """A file's row for its ending, which comes first, and one for each live object."""
    def told(state: str, **more) -> tuple:
        return (*[None] * 10, {name: more.get(name) for name, _ in _ENDING} | {"state": state, "length": len(data or b"")})

    if data is None:
        return [told("missing")]
    if not data.startswith(b"%PDF-"):
        return [told("corrupt")]
    tops = list(scan(data))
    end = ending(data, tops)
    if end is None:
        return [told("corrupt")]
    lock = None
    if end["Encrypt"] is not None:
        ref = ref_of(end["Encrypt"])
        at = next((begin for obj, _, _, begin, _ in reversed(tops) if ref and obj == ref[0]), None)
        lock = lock_of(values(end["Encrypt"]) if ref is None else values(data, at) if at is not None else None, end["ID"])
        if lock is None:
            return [told("encrypted", encrypted=True)]
    found = live(data, tops, lock, budget)
    out = []
    for obj, (start, gen, head, begin, stop, own) in found.items():
        fields = values(head) if own else None
        kind = fields.get("Type", b"").decode("latin-1") if fields else ""
        is_node = fields is not None and (kind in ("/Page", "/Pages", "/Catalog") or "Kids" in fields or "Parent" in fields)
        kids = [k for k, _ in refs_of(fields["Kids"])] if is_node and "Kids" in fields else [] if kind == "/Pages" else None
        plain = stream_bytes(data[begin:stop], fields, lock, obj, gen) if contents and begin is not None and fields.get("Subtype") != b"/Image" and kind not in ("/ObjStm", "/XRef") else None
        node = [(k.encode().decode(), fields[k]) for k in (*INHERITED, *OWN) if k in fields] if is_node else None
        out.append((obj, gen, start, kind, head, begin, stop, plain, kids, node, None))
    facts = {"startxref": end["startxref"], "form": end["form"], "root": end["root"][0], "root_gen": end["root"][1], "size": end["size"], "largest": max(found, default=0), "encrypted": lock is not None}
    return [told("open", **facts), *out]


def parsed(files: DataFrame, key: str, content: str = "content", contents: bool = False, budget: int = BUDGET) -> DataFrame:
    """A row for the ending of each file (obj is null) and one for each of its live objects.

    ending.state is missing (no bytes), corrupt (no header, or no way to the root), encrypted (no empty
    password opens it) or open; only open files have objects.  head holds the dictionary or other value, without stream; with
    `contents`, plain holds the bytes of streams that are no images.  A file is parsed in one task, as it is one value.
    """
    kind = dict(files.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.map_(pa.string(), pa.binary()), pa.struct([(n, _KIND[t]) for n, t in _ENDING])]
        names = ["key", "obj", "gen", "start", "kind", "head", "stream_start", "stream_end", "plain", "kids", "node", "ending"]
        for batch in batches:
            for name, data in zip(batch.column(0), batch.column(1)):
                rows = _rows(data.as_py(), budget, contents)
                yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(rows), batch.column(0).type), *(pa.array(c, t) for c, t in zip(zip(*rows), types))], names)

    return files.select(F.col(key), F.col(content)).mapInArrow(run, f"key {kind}, {PARSED}").withColumnRenamed("key", key)
