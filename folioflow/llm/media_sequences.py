"""Documents as ordered sequences of text and media, with media resolved by digest.

HTML is parsed into items in reading order: runs of text, and references to media with their
captions. References name content by digest (`sha256:...`); a join by digest resolves them to what
a media store holds, while position and caption stay with the item. Media are stored as 8-bit grey
images (binary PGM) of 64 samples a row, or as any bytes the caller brings.

Cases: null or empty html gives no items. Markup that is not closed ends with the document; script,
style and template contents and comments are no text. White space in text and captions is
collapsed, and blank text gives no item. A caption is the figure's caption, else the alt text, else
the title, else null. A reference that no stored media has stays, with null columns. Repeated
references each resolve; repeated media of one digest count once. Repeated rows each give their
items. Very long texts are one item. Payloads are whole rows of samples, at least one, so empty and
null contents are 64 zero samples. Empty tables give empty results. Of clashing names, those of the
store's columns are refused; other columns of the documents are dropped.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import stage, table

ROW = 64
MEDIA_TAGS = ("img", "video", "audio", "source", "embed")
SILENT = ("script", "style", "template")
BREAKS = (
    "p div li ul ol br tr table h1 h2 h3 h4 h5 h6 article section header footer nav blockquote pre figure title"
).split()
ITEM = "position int, kind string, text string, ref string, caption string"


class _Items(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.held: list[str] = []
        self.silent = 0
        self.figures: list[dict] = []
        self.in_caption = 0

    def flush(self) -> None:
        text = " ".join("".join(self.held).split())
        self.held = []
        if text:
            self.items.append({"kind": "text", "text": text, "ref": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        if tag in SILENT:
            self.silent += 1
        elif tag == "figure":
            self.flush()
            self.figures.append({"from": len(self.items), "caption": []})
        elif tag == "figcaption" and self.figures:
            self.flush()
            self.in_caption += 1
        elif tag in MEDIA_TAGS:
            given = {k: v for k, v in attrs if v}
            if "src" in given:
                self.flush()
                caption = " ".join((given.get("alt") or given.get("title") or "").split())
                item = {"kind": "media", "text": None, "ref": given["src"], "caption": caption or None}
                self.items.append(item)
        elif tag in BREAKS and not self.in_caption:
            self.flush()

    def handle_endtag(self, tag):
        if tag in SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag == "figcaption":
            self.in_caption = max(0, self.in_caption - 1)
        elif tag == "figure" and self.figures:
            self.flush()
            self._close_figure()
        elif tag in BREAKS and not self.in_caption:
            self.flush()

    def _close_figure(self) -> None:
        figure = self.figures.pop()
        caption = " ".join("".join(figure["caption"]).split())
        if caption:
            for item in self.items[figure["from"] :]:
                if item["kind"] == "media":
                    item["caption"] = caption
        self.in_caption = 0

    def handle_data(self, data):
        if self.silent:
            return
        if self.in_caption and self.figures:
            self.figures[-1]["caption"].append(data)
        else:
            self.held.append(data)

    def close(self):
        super().close()
        self.flush()
        while self.figures:
            self._close_figure()


def parse_items(html: str | None) -> list[dict]:
    """Text and media of a page in reading order."""
    if not html:
        return []
    parser = _Items()
    parser.feed(html)
    parser.close()
    return [{"position": i, **item} for i, item in enumerate(parser.items)]


def sequences(docs: DataFrame, key: str = "doc_id", html: str = "html") -> DataFrame:
    """One row per item: key, position, kind (text or media), text, ref, caption."""
    pages = docs.select(F.col(key), F.col(html).alias("_html"))
    names = [x.split()[0] for x in ITEM.split(", ")]
    kinds = [pa.int32(), *[pa.string()] * 4]
    key_type = docs.schema[key].dataType.simpleString()

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [parse_items(x) for x in batch.column("_html").to_pylist()]
            rows = np.repeat(np.arange(len(found)), [len(x) for x in found])
            items = [item for one in found for item in one]
            columns = [pa.array([i[n] for i in items], k) for n, k in zip(names, kinds)]
            keys = batch.column(key).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, *columns], [key, *names])

    return pages.mapInArrow(over, f"`{key}` {key_type}, {ITEM}")


def resolve(items: DataFrame, store: DataFrame) -> DataFrame:
    """Items with the store's columns; store: digest and more, one row per digest.

    Adaptive execution splits a digest that very many items refer to.
    """
    clash = set(items.columns) & set(store.columns)
    if clash:
        raise ValueError(f"columns of both sides: {sorted(clash)}")
    digest = F.when(F.startswith("ref", F.lit("sha256:")), F.substring("ref", 8, 64))
    keyed = items.withColumn("_digest", digest)
    return keyed.join(store, keyed["_digest"] == store["digest"], "left").drop("_digest")


def gathered(items: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per document with its items in order; a document's items meet in one task."""
    columns = ["position", *[c for c in items.columns if c not in (key, "position")]]
    return items.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("items"))


def payload(content: Column) -> Column:
    """Bytes and zeros up to whole rows of samples, at least one row."""
    data = F.coalesce(content.cast("binary"), F.lit(b""))
    size = F.greatest(F.lit(1), F.ceil(F.octet_length(data) / F.lit(ROW))) * ROW
    return F.rpad(data, size.cast("int"), F.lit(b"\x00"))


def grey_image(samples: Column) -> Column:
    """A binary PGM of 64 samples a row."""
    rows = (F.octet_length(samples) / ROW).cast("long").cast("string")
    return F.concat(F.concat(F.lit(f"P5\n{ROW} "), rows, F.lit("\n255\n")).cast("binary"), samples)


def read_image(data: bytes) -> np.ndarray:
    """Samples of a binary PGM with one byte each, as rows."""
    head = re.match(rb"P5\s+(\d+)\s+(\d+)\s+(\d+)\s", data)
    if not head or not 0 < int(head[3]) < 256:
        raise ValueError(f"no 8-bit PGM: {data[:20]!r}")
    width, height = int(head[1]), int(head[2])
    if len(data) - head.end() != width * height:
        raise ValueError(f"{len(data) - head.end()} samples, {width} x {height} expected")
    return np.frombuffer(data, np.uint8, offset=head.end()).reshape(height, width)


def feature(samples: np.ndarray) -> str:
    """Size, mean, deviation, entropy in bits and distinct values of the samples."""
    count = np.bincount(samples.ravel(), minlength=256)
    total, value = samples.size, np.arange(256)
    mean = (count @ value) / total
    deviation = np.sqrt(max(0.0, (count @ value**2) / total - mean * mean))
    share = count[count > 0] / total
    entropy = abs(float(-(share * np.log2(share)).sum()))
    return (
        f"{samples.shape[1]}x{samples.shape[0]} mean={mean:.4f} std={deviation:.4f} "
        f"entropy={entropy:.4f} distinct={len(share)}"
    )


MEASURED = (
    "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, "
    "media_bytes long, media_sha256 string, feature string"
)


def measured(store: DataFrame, tail: int = 64) -> DataFrame:
    """What the stored images of store(digest, media) hold, one row per digest.

    Images are read where they lie; only their digests and figures are shuffled.
    """

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in MEASURED.split(", ")]
        for batch in batches:
            out = []
            for digest, media in zip(batch.column("digest").to_pylist(), batch.column("media")):
                data = media.as_py()
                samples = read_image(data)
                content = samples.tobytes()
                out.append(
                    (
                        digest,
                        len(content),
                        hashlib.sha256(content).hexdigest(),
                        zlib.crc32(content[-tail:]),
                        len(data),
                        hashlib.sha256(data).hexdigest(),
                        feature(samples),
                    )
                )
            columns = list(zip(*out)) or [()] * len(names)
            kinds = [pa.int64() if n in ("payload_bytes", "tail_crc32", "media_bytes") else pa.string() for n in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    rows = store.select("digest", "media").mapInArrow(over, MEASURED)
    others = [c for c in rows.columns if c != "digest"]
    one = rows.groupBy("digest").agg(F.min(F.struct(*others)).alias("_m"))
    return one.select("digest", "_m.*")


def op9_media_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text becomes an image and an html document that refers to it.

    The image is stored once per row, where it is made; the document carries the text's byte
    length in its caption, from which it is read back.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    image = grey_image(payload(F.col("text")))
    held = docs.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).alias("n"),
        image.alias("media"),
    )
    store = stage(held.select("doc_id", "n", F.sha2("media", 256).alias("digest"), "media"))
    head, middle, last = (
        "<article><p>Text as an image</p><figure><img src='sha256:",
        f"' alt='{escape('8-bit samples')}'><figcaption>",
        " bytes</figcaption></figure></article>",
    )
    pages = store.select(
        "doc_id",
        F.concat(F.lit(head), "digest", F.lit(middle), F.col("n").cast("string"), F.lit(last)).alias("html"),
    )
    items = sequences(pages).where(F.col("kind") == "media")
    return resolve(items, measured(store)).select(
        "doc_id",
        F.substring_index("caption", " ", 1).cast("long").alias("n_bytes"),
        "payload_bytes",
        "payload_sha256",
        "tail_crc32",
        "media_bytes",
        "media_sha256",
        "feature",
    )
