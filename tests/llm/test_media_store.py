"""Media from another encoder, lookups in the token store, and decoding over whole runs of windows."""

import public_tokenizers
import numpy as np
import pytest

from tidemark.llm import jpeg, pii, token_store, tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


class Java:
    """The JVM's own JPEG library, as an encoder and a decoder that share nothing with the module."""

    def __init__(self, spark):
        self.jvm, self.gateway = spark._jvm, spark.sparkContext._gateway
        self.io, self.image = self.jvm.javax.imageio, self.jvm.java.awt.image.BufferedImage

    def encode(self, pixels, quality):
        high, wide = pixels.shape[:2]
        grey = pixels.ndim == 2
        image = self.image(wide, high, 10 if grey else 1)
        raster = image.getRaster()
        for y in range(high):
            for x in range(wide):
                for band in range(1 if grey else 3):
                    raster.setSample(x, y, band, int(pixels[y, x] if grey else pixels[y, x, band]))
        writer = self.io.ImageIO.getImageWritersByFormatName("jpeg").next()
        param = writer.getDefaultWriteParam()
        param.setProgressiveMode(1)
        param.setCompressionMode(2)
        param.setCompressionQuality(quality)
        out = self.jvm.java.io.ByteArrayOutputStream()
        writer.setOutput(self.io.ImageIO.createImageOutputStream(out))
        writer.write(None, self.io.IIOImage(image, None, None), param)
        writer.getOutput().flush()
        return bytes(out.toByteArray())

    def decode(self, data):
        image = self.io.ImageIO.read(self.jvm.java.io.ByteArrayInputStream(bytearray(data)))
        raster, bands = image.getRaster(), image.getRaster().getNumBands()
        return np.array([[[raster.getSample(x, y, b) for b in range(bands)] for x in range(image.getWidth())] for y in range(image.getHeight())])


def scans(data):
    """(components, first, last, high, low) of each scan."""
    found, at = [], data.find(b"\xff\xda")
    while at >= 0:
        n = data[at + 4]
        first, last, bits = data[at + 5 + 2 * n : at + 8 + 2 * n]
        found.append((n, first, last, bits >> 4, bits & 15))
        at = data.find(b"\xff\xda", at + 2)
    return found


@pytest.mark.parametrize("quality", [0.4, 0.95])
def test_grey_file_of_another_encoder(spark, quality):
    java, rng = Java(spark), np.random.default_rng(3)
    y, x = np.mgrid[:37, :43]
    pixels = np.clip(120 + 60 * np.sin(x / 5) + 40 * np.cos(y / 3 + x / 9) + rng.normal(0, 12, (37, 43)), 0, 255).astype(np.uint8)
    data = java.encode(pixels, quality)
    kinds = scans(data)
    assert {(f, last) for _, f, last, _, _ in kinds} > {(0, 0)} and any(h for _, _, _, h, _ in kinds)  # several bands, and refinements
    own = jpeg.decode_rgb(jpeg.decode_coefficients(data))
    assert own.shape == (37, 43, 3) and (np.abs(own[..., :1].astype(int) - java.decode(data)) <= 1).all()


def test_colour_file_of_another_encoder(spark):
    """Chroma is even over each half, so how it is upsampled shows in the seam alone."""
    java, rng = Java(spark), np.random.default_rng(4)
    light = np.clip(rng.normal(0, 25, (40, 48)), -60, 60)[..., None]
    tint = np.where(np.arange(48)[None, :, None] < 32, [150, 110, 90], [90, 120, 150])
    pixels = np.clip(light + tint, 0, 255).astype(np.uint8)
    data = java.encode(pixels, 0.9)
    image = jpeg.decode_coefficients(data)
    assert [(c.h, c.v) for c in image.components] == [(2, 2), (1, 1), (1, 1)]
    assert scans(data)[0][0] == 3  # the first scan interleaves the components
    off = np.abs(jpeg.decode_rgb(image).astype(int) - java.decode(data))
    off[:, 29:35] = 0
    assert off.max() <= 6 and off.mean() < 1


def test_the_carrier_is_a_file_that_others_read(spark):
    java = Java(spark)
    data = jpeg.encode_payload(bytes(np.random.default_rng(5).integers(0, 256, 64 * 13, dtype=np.uint8)))
    image = jpeg.decode_coefficients(data)
    other = java.decode(data)
    assert other.shape[:2] == (image.height, image.width)
    # the luminance of both, as the chroma is upsampled in different ways
    y = lambda rgb: rgb @ np.array([0.299, 0.587, 0.114])
    own = jpeg.decode_rgb(image).astype(int)
    clear = ((own > 0) & (own < 255)).all(2) & ((other > 0) & (other < 255)).all(2)
    assert not clear.any() or np.abs(y(own) - y(other))[clear].max() <= 2


def test_load_of_files_from_elsewhere(spark):
    java = Java(spark)
    grey = java.encode(np.full((9, 11), 77, np.uint8), 0.9)
    rows = spark.createDataFrame([(1, bytearray(grey)), (2, None), (3, bytearray(jpeg.encode_payload(b"x" * 64)))], "doc_id long, media binary")
    got = {r.doc_id: r for r in jpeg.load(rows).collect()}
    assert (got[1].payload, got[1].width, got[1].height) == (None, 11, 9) and set(got[1].rgb) == {77}
    assert got[2].feature is None and got[3].payload == b"x" * 64


def test_lookup_reads_the_wanted_documents(spark, tmp_path):
    rows = [(7 * k, f"document number {k} " * (k % 5 + 1)) for k in range(9000)] + [(None, "no id"), (14, "again"), (21, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    token_store.write(docs, f"{tmp_path}/s", PATH)
    assert len(spark.read.parquet(f"{tmp_path}/s/format").first().edges) >= 1
    encode, end = tokens.encoder(PATH).one, b"\x00" * 4
    for ids in ([14, 62993, 3, 21], [None], [], [7 * k for k in range(0, 9000, 1000)]):
        want = sorted(((i, encode(t or "") + end) for i, t in rows if i in ids), key=repr)
        made = token_store.lookup(spark, f"{tmp_path}/s", ids)
        assert sorted(((r.id, bytes(r.tokens)) for r in made.collect()), key=repr) == want
    plan = token_store.lookup(spark, f"{tmp_path}/s", [14])._jdf.queryExecution().toString()
    assert "PushedFilters: [In(bucket" in plan or "PushedFilters: [IsNotNull(bucket), EqualTo(bucket" in plan
    token_store.write(docs.limit(0), f"{tmp_path}/e", PATH)
    assert token_store.lookup(spark, f"{tmp_path}/e", [1, None]).count() == 0


def plain_viterbi(e, t):
    best = [(float(x), [k]) for k, x in enumerate(e[0])]
    for row in e[1:]:
        best = [max(((s + t[p[-1], k] + row[k], p + [k]) for s, p in best), key=lambda b: b[0]) for k in range(len(row))]
    return max(best, key=lambda b: b[0])[1]


def test_runs_of_windows_are_decoded_as_one():
    tagger = pii.fit(*pii.training_windows(["call 555-123-4567 or mail ab.c@de.org, room 12 on 2024-01-02 " * 3] * 8), steps=25)
    texts = ["", "no marks", "1", "x" * 300 + "5" + "y" * 31 + "@" + "z" * 200 + "7", " ".join(f"{k} +49 {k * 7919 % 10**9} w" for k in range(60)), "1" * 500]
    own = [np.concatenate([np.zeros(pii.STRIDE, np.uint8), pii._encoded(t), np.zeros(pii.WIDTH + pii.STRIDE, np.uint8)]) for t in texts]
    runs = [(j, s, n) for j, t in enumerate(texts) for s, n in pii._runs_of(t)]
    held = [sorted({s for m in pii._TRIGGER.finditer(t) for s in (m.start() // 32 * 32 - 32, m.start() // 32 * 32)}) for t in texts]
    assert [[s + 32 * k for s, n in pii._runs_of(t) for k in range(n)] for t in texts] == held
    want = [[] for _ in texts]
    for j, s, n in runs:
        length = (n - 1) * pii.STRIDE + pii.WIDTH
        joint = np.zeros((length, pii.N_TAGS))
        for at in range(length):
            parts = [(k, at - k * pii.STRIDE) for k in range(n) if 0 <= at - k * pii.STRIDE < pii.WIDTH]
            weights = [min(x + 1, pii.WIDTH - x) for _, x in parts]
            e = [tagger.emissions(own[j][None, s + (k + 1) * pii.STRIDE :][:, : pii.WIDTH])[0, x] for k, x in parts]
            joint[at] = sum(w * v for w, v in zip(weights, e)) / sum(weights)
        want[j] += list(pii._spans(np.array(plain_viterbi(joint, tagger.weights["t"])), s))
    assert pii.tag_texts(tagger, texts) == want
