"""Media columns: documents as ordered sequences of text and media references, with payloads resolved by digest.

HTML is parsed into an array of structs (kind, text, digest, caption) in document order. Payloads live in a media
table, once for each digest; a join on the digest, split where very many references name one, brings a payload (or what
was computed from it) back to each reference, and the sequence's order and captions stay as they were.

Payloads are stored as 8-bit gray samples in PNG files, WIDTH to a row: bytes padded with 0 to whole rows, compressed
without loss, with the checksums that the format prescribes. A text's page holds its paragraphs, and among them its
payload as one figure for each FRAME_BYTES, captioned with the bytes it stands for. Reading puts the figures of a page
together in the order in which they stand, and fails if their captions don't fit each other and the payload.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from html import escape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytetext as bt
from . import store
from .skew import split_join

WIDTH = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Bytes of a payload that one figure holds; whole rows.
FRAME_BYTES = 1 << 16
#: Bytes that one data chunk of a PNG holds; a longer image takes several, as the format provides.
CHUNK_BYTES = 1 << 30

SEQUENCE = "array<struct<kind:string,text:string,digest:string,caption:string>>"


def padded(data: bytes) -> bytes:
    """data and zeros up to a positive multiple of WIDTH bytes."""
    return data + bytes(-len(data) % WIDTH if data else WIDTH)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    """The payload, whose size is a multiple of WIDTH, as one PNG."""
    part = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(part), WIDTH + 1), np.uint8)  # each row is led by its filter, 0
    lines[:, 1:] = part
    packed = zlib.compress(lines.tobytes(), 6)
    header = struct.pack(">IIBBBBB", WIDTH, len(part), 8, 0, 0, 0, 0)
    data = [_chunk(b"IDAT", packed[at : at + CHUNK_BYTES]) for at in range(0, len(packed), CHUNK_BYTES)]
    return b"".join([SIGNATURE, _chunk(b"IHDR", header), *data, _chunk(b"IEND", b"")])


def from_png(media: bytes) -> bytes:
    """The samples of a file of `to_png`; fails on a damaged one."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, kind, width, packed = 8, b"", 0, []
    while kind != b"IEND":
        size, kind = struct.unpack(">I4s", media[at : at + 8])
        data = media[at + 8 : at + 8 + size]
        if struct.unpack(">I", media[at + 8 + size : at + 12 + size])[0] != zlib.crc32(kind + data):
            raise ValueError("damaged PNG")
        if kind == b"IHDR":
            width = struct.unpack(">I", data[:4])[0]
        elif kind == b"IDAT":
            packed.append(data)
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(-1, width + 1)
    if at != len(media) or lines[:, 0].any():
        raise ValueError("a file that this reader doesn't know")
    return lines[:, 1:].tobytes()


class _Sequence(HTMLParser):
    """Text runs and media references of a page in order. Scripts and styles are left out; white space runs become one space."""

    SKIP = {"script", "style", "template", "noscript"}
    BLOCKS = {"p", "div", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "br", "tr", "td", "th", "table", "section", "article", "nav", "header", "footer", "main", "pre", "blockquote", "figure", "title", "body", "head", "html", "form", "aside"}
    MEDIA = {"img", "video", "audio", "source", "embed"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.text: list[str] = []
        self.skipped = 0
        self.figure: list[int] = []
        self.caption: list[str] | None = None

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            self.items.append({"kind": "text", "text": text, "digest": None, "caption": None})

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in self.SKIP:
            self.skipped += 1
        elif tag in self.MEDIA:
            self.flush()
            held = dict(attrs)
            name = held.get("src") or ""
            self.items.append({"kind": "media", "text": None, "digest": name.removeprefix("cas:") if name.startswith("cas:") else hashlib.sha256(name.encode("utf-8", "surrogatepass")).hexdigest(), "caption": held.get("alt")})
        elif tag == "figure":
            self.flush()
            self.figure.append(len(self.items))
        elif tag == "figcaption":
            self.flush()
            self.caption = []
        elif tag in self.BLOCKS:
            self.flush()

    def handle_endtag(self, tag: str) -> None:
        if tag in self.SKIP:
            self.skipped = max(0, self.skipped - 1)
        elif tag == "figcaption" and self.caption is not None:
            said = " ".join("".join(self.caption).split())
            self.caption = None
            for item in self.items[self.figure[-1] if self.figure else len(self.items) - 1 :]:
                if item["kind"] == "media":
                    item["caption"] = said
        elif tag == "figure":
            self.flush()
            if self.figure:
                self.figure.pop()
        elif tag in self.BLOCKS:
            self.flush()

    def handle_data(self, data: str) -> None:
        if not self.skipped:
            (self.text if self.caption is None else self.caption).append(data)


def parse_html(html: str | None) -> list[dict]:
    """The page's sequence; empty for null, empty or contentless pages. A media item's caption is its figure's, else its alt text."""
    parser = _Sequence()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return parser.items


def interleave(df: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id_col, items): the sequence of each row's page; see parse_html. Repeated rows give repeated results; other columns aren't read.

    References to content-addressed media (`cas:` and a hex digest) keep that digest; others get their address's SHA-256.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            items = [parse_html(x) for x in batch.column(1).to_pylist()]
            shape = pa.list_(pa.struct([(c, pa.string()) for c in ("kind", "text", "digest", "caption")]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(items, shape)], names=[id_col, "items"])

    store.bound_batches(df.sparkSession)
    return df.select(F.col(id_col), F.col(html_col).cast("string").alias("html_")).mapInArrow(run, f"`{id_col}` {kind}, items {SEQUENCE}")


def resolve(sequences: DataFrame, media: DataFrame, id_col: str) -> DataFrame:
    """sequences(id_col, items) with, for each media item, the columns of media(digest, ...): one row (id_col, pos, caption, text, digest, ...)
    for each item in `pos` order; a digest that media lacks keeps its row with nulls. media must hold a digest once."""
    flat = sequences.select(id_col, F.posexplode("items").alias("pos", "item")).select(id_col, "pos", "item.kind", "item.text", "item.digest", "item.caption")
    return split_join(store.keep(flat, "media-items"), media, "digest", [id_col, "pos"], "left")


def _payloads(column: pa.Array):
    """Yields (number of bytes, payload) of each text; null is an empty text."""
    data, bounds = bt.buffers(column)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        yield b - a, padded(data[a:b].tobytes())


def text_pages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, html): a page for each text, its paragraphs and the figures of its payload's frames dealt evenly among them."""

    def run(batches):
        for batch in batches:
            pages = []
            for text, (n, payload) in zip(batch.column(1).to_pylist(), _payloads(batch.column(1))):
                figures = []
                for at in range(0, len(payload), FRAME_BYTES):
                    name = hashlib.sha256(payload[at : at + FRAME_BYTES]).hexdigest()
                    figures.append(f'<figure><img src="cas:{name}" width="{WIDTH}"><figcaption>bytes {at}-{min(n, at + FRAME_BYTES)} of {n}</figcaption></figure>')
                told = [f"<p>{escape(x)}</p>" for x in (text or "").split("\n") if x.strip()]
                cuts = [len(told) * (k + 1) // (len(figures) + 1) for k in range(len(figures))]
                parts = [x for a, b, figure in zip([0, *cuts], cuts, figures) for x in (*told[a:b], figure)]
                pages.append("".join(["<article>", *parts, *told[cuts[-1] :], "</article>"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pages, pa.string())], names=["doc_id", "html"])

    store.bound_batches(df.sparkSession)
    return df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id bigint, html string")


def text_frames(df: DataFrame, text_col: str = "text", unique: bool = True) -> DataFrame:
    """(digest, media): the frames of all texts' payloads in stored form, each distinct one once.

    unique=False: frames stay where their texts lie, so nothing moves, and one comes once from each task that has it."""

    def run(batches):
        seen: set[str] = set()
        for batch in batches:
            for _, payload in _payloads(batch.column(0)):
                names, forms = [], []
                for at in range(0, len(payload), FRAME_BYTES):
                    frame = payload[at : at + FRAME_BYTES]
                    name = hashlib.sha256(frame).hexdigest()
                    if name not in seen:
                        seen.add(name)
                        names.append(name)
                        forms.append(to_png(frame))
                if names:
                    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(forms, pa.binary())], names=["digest", "media"])
                if len(seen) > 500_000:  # a frame may then be handed on twice
                    seen.clear()

    store.bound_batches(df.sparkSession)
    frames = df.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "digest string, media binary")
    return frames.dropDuplicates(["digest"]) if unique else frames


_FACTS = "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
_KINDS = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())


def facts(forms: list[bytes]) -> tuple:
    """What is computed from stored forms that follow each other.

    feature: rows of samples, mean sample to a thousandth, and the share of each of the eight ranges of 32 values in per mille."""
    payload, form = b"".join(from_png(x) for x in forms), b"".join(forms)
    samples = np.frombuffer(payload, np.uint8)
    parts = np.bincount(samples >> 5, minlength=8) * 1000 // len(samples)
    told = f"rows={len(samples) // WIDTH};mean={int(samples.sum(dtype=np.int64)) * 1000 // len(samples)};hist={'/'.join(map(str, parts.tolist()))}"
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(form), hashlib.sha256(form).hexdigest(), told


def features(media: DataFrame) -> DataFrame:
    """(digest and what is computed from the stored bytes) of each row of media(digest, media); fails if they don't have the digest."""

    def run(batches):
        for batch in batches:
            names, found = batch.column(0), [facts([x]) for x in batch.column(1).to_pylist()]
            for name, x in zip(names.to_pylist(), found):
                if x[1] != name:
                    raise ValueError(f"media {name} was damaged")
            yield pa.RecordBatch.from_arrays([names, *(pa.array([x[k] for x in found], t) for k, t in enumerate(_KINDS))], names=["digest", *(x.split()[0] for x in _FACTS.split(", "))])

    return media.select("digest", "media").mapInArrow(run, f"digest string, {_FACTS}")


_SPAN = r"^bytes (\d+)-(\d+) of (\d+)$"


def read_pages(pages: DataFrame, media: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """(doc_id, n_bytes, facts) of each page of `text_pages`, from its figures in order and media(digest, media), stored.

    parts(digest, media): where the figures of pages with several are, each once; media, if it isn't given, which then
    must hold each once. Given parts, media may hold a figure several times.

    What concerns a single figure is computed where its bytes lie, and only small rows move; the bytes of a page with
    several figures meet in one row, as they are one text's."""
    found = pages.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", F.filter(F.transform("items", lambda x, k: F.struct(k.alias("pos"), x["kind"].alias("kind"), x["digest"].alias("digest"), x["caption"].alias("caption"))), lambda x: x["kind"] == "media").alias("items"))
    number = lambda k: F.regexp_extract("item.caption", _SPAN, k).cast("bigint")
    refs = found.select("row", "doc_id", F.size("items").alias("figures"), F.explode("items").alias("item")).select("row", "doc_id", "figures", "item.pos", "item.digest", number(1).alias("first"), number(2).alias("last"), number(3).alias("n_bytes"))
    refs = store.keep(refs, "media-references")
    columns = ["doc_id", "n_bytes", *(x.split()[0] for x in _FACTS.split(", "))]
    known = features(media) if parts is None else features(media).dropDuplicates(["digest"])
    single = split_join(refs.where("figures = 1"), known, "digest", ["row"], "left").select(*columns, "first", "last", F.lit(True).alias("fits"))
    wide = split_join(refs.where("figures > 1"), media if parts is None else parts, "digest", ["row"], "left")
    wide = wide.groupBy("row", "doc_id", "n_bytes").agg(F.sort_array(F.collect_list(F.struct("pos", "first", "last", "media"))).alias("parts"))
    follow = F.forall(F.sequence(F.lit(1), F.size("parts") - 1), lambda k: F.get("parts", k)["first"] == F.get("parts", k - 1)["last"])
    wide = wide.select("doc_id", "n_bytes", F.get("parts", F.lit(0))["first"].alias("first"), F.get("parts", F.size("parts") - 1)["last"].alias("last"), follow.alias("fits"), F.transform("parts", lambda x: x["media"]).alias("forms"))

    def join(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                x = facts(batch.column(5)[k].as_py())
                yield pa.RecordBatch.from_arrays([c.slice(k, 1) for c in batch.columns[:5]] + [pa.array([v], t) for v, t in zip(x, _KINDS)], names=["doc_id", "n_bytes", "first", "last", "fits", *columns[2:]])

    wide = wide.mapInArrow(join, f"doc_id bigint, n_bytes bigint, first bigint, last bigint, fits boolean, {_FACTS}")
    every = single.unionByName(wide)
    whole = F.coalesce(F.col("fits") & (F.col("first") == 0) & (F.col("last") == F.col("n_bytes")) & (F.greatest(F.lit(WIDTH), F.ceil(F.col("n_bytes") / WIDTH) * WIDTH) == F.col("payload_bytes")), F.lit(False))
    checked = F.when(whole, F.col("n_bytes")).otherwise(F.raise_error(F.lit("a page's figures don't give its payload")).cast("bigint"))
    return every.select("doc_id", checked.alias("n_bytes"), *columns[2:])


def text_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The contract's digest: each text stored as media, its page parsed, its references resolved by digest and read back.

    Payloads of one frame are stored by the tasks that read their texts, so that no bytes move: one is stored once a task
    that has it. The frames of longer ones are stored once altogether.

    Null and empty texts are 64 zero bytes; rows that repeat an id or a text give a row each; ids are whole numbers;
    other columns aren't read. An empty table gives an empty result."""
    with store.scratch():
        longer = F.coalesce(F.octet_length(F.col(text_col).cast("string")) > FRAME_BYTES, F.lit(False))
        media = store.keep(text_frames(df.where(~longer), text_col, unique=False), "media", "none")
        parts = store.keep(text_frames(df.where(longer), text_col), "media-parts", "none")
        return store.keep(read_pages(interleave(text_pages(df, id_col, text_col), "doc_id", "html"), media, parts), "media-facts", outer=True)


def page_digests(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id_col, n_texts, n_media, n_captions, text_chars, items_sha256) of each page's sequence.

    items_sha256: hex digest of all items in order, each as kind, text or caption, and digest, with a line break behind each
    of the three (null: empty). A null page has no items."""
    items = interleave(pages, id_col, html_col)
    count = lambda test: F.size(F.filter("items", test)).cast("bigint")
    told = F.transform("items", lambda x: F.concat(x["kind"], F.lit("\n"), F.coalesce(x["text"], x["caption"], F.lit("")), F.lit("\n"), F.coalesce(x["digest"], F.lit("")), F.lit("\n")))
    chars = F.aggregate("items", F.lit(0).cast("bigint"), lambda n, x: n + F.coalesce(F.char_length(x["text"]), F.lit(0)))
    return items.select(id_col, count(lambda x: x["kind"] == "text").alias("n_texts"), count(lambda x: x["kind"] == "media").alias("n_media"), count(lambda x: x["caption"].isNotNull()).alias("n_captions"), chars.alias("text_chars"), F.sha2(F.array_join(told, "").cast("binary"), 256).alias("items_sha256"))
