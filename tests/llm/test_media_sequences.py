import hashlib
import zlib

import numpy as np
import pytest
from compare import duck
from pyspark.sql import functions as F

from folioflow.llm import media_sequences as M


def test_registered_query_against_plain_python(spark, sf):
    got = {r["doc_id"]: r for r in M.op9_media_sequences(spark, sf).collect()}
    rows = duck(sf).execute("SELECT doc_id, text FROM documents").fetchall()
    assert len(got) == len(rows)
    for doc_id, text in rows:
        raw = (text or "").encode()
        data = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        media = b"P5\n64 %d\n255\n" % (len(data) // 64) + data
        r = got[doc_id]
        assert (r["n_bytes"], r["payload_bytes"], r["media_bytes"]) == (len(raw), len(data), len(media))
        assert r["payload_sha256"] == hashlib.sha256(data).hexdigest()
        assert r["media_sha256"] == hashlib.sha256(media).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(data[-64:])
        values = np.frombuffer(data, np.uint8)
        assert r["feature"].startswith(f"64x{len(data) // 64} mean={values.mean():.4f} ")
        assert f"distinct={len(set(data))}" in r["feature"]


HTML = """<html><head><title>T &amp; t</title><style>p{}</style><script>var x='<img src=no>'</script></head>
<body><p>One <b>two</b>
 three<img src="sha256:aa" alt="the  alt"> four</p><!-- <img src='no'> -->
<figure><img src='sha256:bb' alt='alt'><figcaption>A <i>good</i>
caption</figcaption></figure><figure><video><source src="v.mp4" title="movie"></video></figure>
<img alt='no source'><p>end<figure><img src=c><figcaption>open"""


def test_items_in_order():
    got = [(i["position"], i["kind"], i["text"] or i["ref"], i["caption"]) for i in M.parse_items(HTML)]
    assert got == [
        (0, "text", "T & t", None),
        (1, "text", "One two three", None),
        (2, "media", "sha256:aa", "the alt"),
        (3, "text", "four", None),
        (4, "media", "sha256:bb", "A good caption"),
        (5, "media", "v.mp4", "movie"),
        (6, "text", "end", None),
        (7, "media", "c", "open"),
    ]


def test_positions_and_captions_stay_aligned(spark):
    digest = {n: hashlib.sha256(n.encode()).hexdigest() for n in "abc"}
    pages = [
        (i, "".join(f"<p>t{i}{j}</p><img src='sha256:{digest['abc'[j % 3]]}' alt='c{j}'>" for j in range(i)), "x")
        for i in range(8)
    ]
    docs = spark.createDataFrame(pages, "doc_id long, html string, text string").repartition(3)
    store = spark.createDataFrame([(digest[n], n.encode()) for n in "ab"], "digest string, media binary")
    rows = M.gathered(M.resolve(M.sequences(docs), store)).collect()
    assert {r["doc_id"] for r in rows} == set(range(1, 8))
    for r in rows:
        assert [x["position"] for x in r["items"]] == list(range(2 * r["doc_id"]))
        for j in range(r["doc_id"]):
            text, media = r["items"][2 * j], r["items"][2 * j + 1]
            assert text["text"] == f"t{r['doc_id']}{j}" and media["caption"] == f"c{j}"
            assert media["media"] == {0: b"a", 1: b"b", 2: None}[j % 3]
    with pytest.raises(ValueError):
        M.resolve(M.sequences(docs), store.withColumn("caption", F.lit(1)))


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "é" * 32), (4, "x" * 1_000_000), (4, "x" * 1_000_000), (None, "a\0")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    store = df.select(M.grey_image(M.payload(F.col("text"))).alias("media")).withColumn("digest", F.sha2("media", 256))
    got = sorted(r["payload_bytes"] for r in M.measured(store).collect())
    assert got == [64, 64, 64, 64 * 15625]
    assert M.measured(store.where("false")).collect() == []
    empty = spark.createDataFrame([(1, None), (2, ""), (3, "  <p> </p>")], "doc_id long, html string")
    assert M.sequences(empty).collect() == [] and M.sequences(empty.where("false")).collect() == []


@pytest.mark.parametrize("bad", [b"", b"P6\n1 1\n255\nabc", b"P5\n2 1\n255\nabc", b"P5\n1 1\n999\na"])
def test_bad_images_are_refused(bad):
    with pytest.raises(ValueError):
        M.read_image(bad)
