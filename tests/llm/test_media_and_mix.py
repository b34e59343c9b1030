"""Matroska, mixing, WARC and the pipeline against specifications and brute force."""

import gzip
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from newsloom.llm import matroska as m
from newsloom.llm import mixing, queries, warc

SF = "/root/testdata/sf0.001"


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


# Matroska


@pytest.mark.parametrize("n", [64, 128, 511, 512, 513, 4096, 4160, 65536, 65600, 200_000])
def test_pcm_round_trip(n):
    payload = random.Random(n).randbytes(n)
    data = m.write_pcm(payload)
    media = m.parse(data)
    assert media.error is None and m.samples(data, media) == payload and media.tracks == {1: "A_PCM/INT/LIT"}
    assert len(media.cues) == len(media.clusters) == -(-n // (m.FRAME * m.LACE * m.BLOCKS))
    assert all(data[offset : offset + 4] == m.CLUSTER.to_bytes(4, "big") for _, _, offset in media.cues)
    assert [p[5] for p in media.packets][:1] == [m.NO_LACE if n <= m.FRAME else m.FIXED_LACE if n % m.FRAME == 0 else media.packets[0][5]]


@pytest.mark.parametrize("mode", [m.XIPH_LACE, m.EBML_LACE, m.FIXED_LACE])
def test_lacing(mode):
    sizes = [300] * 5 if mode == m.FIXED_LACE else [1, 600, 255, 254, 70_000, 3]
    frames = [bytes([i]) * n for i, n in enumerate(sizes)]
    cluster = m.element(m.CLUSTER, m.number(m.TIME, 1000) + m.block(2, -5, frames, mode))
    data = m.element(m.EBML, b"") + m.element(m.SEGMENT, cluster)
    media = m.parse(data)
    assert media.error is None and [data[p[2] : p[2] + p[3]] for p in media.packets] == frames
    assert {(p[0], p[1], p[5]) for p in media.packets} == {(2, 995_000_000, mode)}


def test_groups_unknown_sizes_and_faults():
    frame_data = m.size_bytes(1) + (7).to_bytes(2, "big") + b"\x00" + b"abc"
    group = m.element(m.GROUP, m.element(m.BLOCK, frame_data) + m.element(m.REFERENCE, b"\x01"))
    unknown = m.CLUSTER.to_bytes(4, "big") + b"\xff" + m.number(m.TIME, 3) + group
    segment = m.SEGMENT.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + unknown + unknown + m.element(m.CUES, b"")
    media = m.parse(segment)
    assert media.error is None and [(p[1], p[4], p[6]) for p in media.packets] == [(10_000_000, False, 0), (10_000_000, False, 1)]
    whole = m.write_pcm(b"x" * 10_000)
    cut = m.parse(whole[:-2000])
    assert cut.error and m.parse(b"").packets == [] and m.parse(b"\x00\x01").error
    assert m.parse(random.Random(4).randbytes(500)).packets == []


def test_cues_of_several_tracks():
    place = lambda track, at: m.element(m.CUE_TRACK_POSITIONS, m.number(m.CUE_TRACK, track) + m.number(m.CUE_CLUSTER, at))
    cue = m.element(m.CUE, m.number(m.CUE_TIME, 5) + place(1, 10) + place(2, 20))
    media = m.parse(m.element(m.SEGMENT, m.element(m.CUES, cue)))
    assert media.error is None and [(t, at - media.cues[0][2]) for _, t, at in media.cues] == [(1, 0), (2, 10)]


def test_matroska_in_spark(spark):
    rows = frame(spark, [(1, "é" * 100), (1, "é" * 100), (2, None), (None, ""), (3, "x" * 64), (4, "x" * 65)])
    stored = m.store(rows.withColumn("media", F.lit("clash")), keep=(F.col("doc_id"),))
    got = m.describe(stored, "media", (F.col("doc_id"), F.col("n_bytes"))).collect()
    texts = {str(r.doc_id): (r.text or "").encode() for r in rows.collect()}
    for r in got:
        data = texts[str(r.doc_id)]
        payload = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert len({r.feature for r in got if r.doc_id == 1}) == 1 and {r.payload_bytes for r in got if r.doc_id == 3} == {64}
    table = m.packets(stored, "media", (F.col("doc_id"),)).select("doc_id", F.explode("packets").alias("p")).select("doc_id", "p.*")
    assert table.groupBy("doc_id").agg(F.sum("size").alias("n")).where("doc_id = 4").first().n == 128
    assert m.store(rows.where("false")).count() == 0


# Mixing


def fill(sizes, weights, share, cap):
    """Water-filling by its definition: clamp what is above its cap, and share the rest again by weight."""
    total, fixed = sum(sizes.values()) * share, {}
    while True:
        free = [s for s in sizes if s not in fixed]
        rest = total - sum(fixed.values())
        if not free:
            return fixed
        level = rest / sum(weights[s] for s in free)
        over = [s for s in free if weights[s] * level > cap * sizes[s]]
        if not over:
            return fixed | {s: weights[s] * level for s in free}
        fixed |= {s: cap * sizes[s] for s in over}


@pytest.mark.parametrize("seed", range(4))
def test_targets_match_the_definition(spark, seed):
    rng = random.Random(seed)
    names = sorted({f"s{rng.randrange(1000)}" for _ in range(rng.randrange(1, 12))})
    sizes = {n: rng.choice([0, 5, 100, 10_000]) for n in [*names, None]}
    weights = {n: (5.0, 2.0, 1.0)[i % 3] for i, n in enumerate([*names, None])}
    rows = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, source_size long, rows long")
    got = {r.source: r.target for r in mixing.targets(rows).collect()}
    want = fill(sizes, weights, 1.5, 2.0)
    assert got == pytest.approx(want)


def test_mix_comes_to_the_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "STRATUM", 5)
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.randrange(30)), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(200)]
    rows += [(500, None, "a"), (None, "x y", "b"), (7, rows[7][1], rows[7][2]), (501, "t u v", "only"), (502, "", "none")]
    docs = frame(spark, rows, "doc_id long, text string, source string").withColumn("target", F.lit(1))
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(7)).collect()))
    by = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"]
        by.setdefault(r.source, []).append(r)
    for own in by.values():
        assert abs(sum(r.taken for r in own) - own[0].target) < 1.001
    out = mixing.repeat(docs, mixing.mix(docs))
    assert out.columns == docs.columns
    words = {}
    for r in out.collect():
        words[r.source] = words.get(r.source, 0) + len((r.text or "").split())
    # The repeated row counts twice in the mix, and all that is taken of it comes out.
    assert all(words.get(s, 0) == sum(r.taken for r in own) and abs(words.get(s, 0) - own[0].target) < 1.001 for s, own in by.items())
    twice = spark.createDataFrame([(1, "w " * 500, "a", 1), (1, "w " * 500, "a", 2), (2, "v " * 420, "b", 3), (2, "v " * 420, "a", 4), (None, "z " * 30, None, 5), (None, "z " * 30, None, 5)], "doc_id long, text string, source string, __size int")
    mixed = mixing.mix(twice)
    want = {r.source: r.n for r in mixed.groupBy("source").agg(F.sum("taken").alias("n")).collect()}
    got = {r.source: r.n for r in mixing.repeat(twice, mixed).groupBy("source").agg(F.sum(mixing.words("text")).alias("n")).collect()}
    assert got == {k: v for k, v in want.items() if v}
    assert mixing.mix(docs.where("false")).count() == 0


def test_frames_of_a_lace_follow_each_other():
    whole = m.parse(m.write_pcm(bytes(4096)))
    assert [p[1] for p in whole.packets] == [i * 64_000_000 for i in range(8)]
    track = m.element(m.TRACK, m.number(m.TRACK_NUMBER, 2))
    lace = m.size_bytes(2) + bytes(2) + bytes([m.XIPH_LACE << 1]) + m._laced([b"ab", b"c", b"def"], m.XIPH_LACE)
    group = m.element(m.GROUP, m.element(m.BLOCK, lace) + m.number(m.BLOCK_DURATION, 30))
    cluster = m.CLUSTER.to_bytes(4, "big") + b"\xff" + m.number(m.TIME, 5) + group
    file = m.element(m.EBML, b"") + m.SEGMENT.to_bytes(4, "big") + b"\xff" + cluster + m.element(m.TRACKS, track)
    got = m.parse(file + file)
    assert got.error is None and len(got.clusters) == 2 and 2 in got.tracks
    assert [(p[0], p[1], p[3]) for p in got.packets] == [(2, 5_000_000, 2), (2, 15_000_000, 1), (2, 25_000_000, 3)] * 2


# WARC


def test_warc_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "RECORDS", 3)
    big, other = "é\r\n\r\nWARC/1.1\r\n" * 100, "b" * 1000
    rows = [(1, "http://a/\r\nX: y", big), (2, "u", big), (9, None, big), (3, "u", other), (4, "u", "b" * 999), (5, "u", "b" * 999), (6, "u", None), (7, "u", ""), (None, "u", other)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, record_type string")
    warc.write(warc.decide(pages, "page_id", "html"), f"{tmp_path}/w", "page_id", "url", "html")
    records = warc.read(spark, f"{tmp_path}/w")
    got = {r.record_key: r for r in warc.resolve(records).collect()}
    assert len(got) == len(rows)
    for i, _, text in rows:
        data = (text or "").encode()
        twins = [k for k, _, t in rows if t == text and k is not None]
        first = max(twins) if len(data) >= 1000 else i
        want = (len(data), hashlib.sha1(data).hexdigest(), "response" if first == i else "revisit", None if first == i else first)
        assert (got[i].payload_bytes, got[i].digest, got[i].record_type, got[i].refers_to) == want
    stored = {r.record_key: r.payload for r in records.collect()}
    assert bytes(stored[9]).decode() == big and bytes(stored[1]) == b""
    files = sorted((tmp_path / "w").glob("part-*"))
    assert len(files) >= 3 and all(h["content-length"] for f in files for h, _ in warc.parse(gzip.decompress(f.read_bytes())))
    with pytest.raises(ValueError):
        list(warc.parse(b"WARX"))
    warc.write(warc.decide(pages.where("false"), "page_id", "html"), f"{tmp_path}/e", "page_id", "url", "html")
    assert warc.read(spark, f"{tmp_path}/e").count() == 0


# Pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.collect()
    extra = spark.createDataFrame([(9000, "123 456 !!", "en", "src0", 10), (9001, None, None, None, None), (9002, rows[0].text, "en", None, 5)], docs.schema)
    docs = docs.unionByName(extra).withColumn("fp", F.lit("clash"))
    kept = c.language(spark, docs, SF)
    assert kept.columns == list(c.COLUMNS) and {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows} | {9002}
    kept = c.materialise(kept)
    near = c.near_duplicates(spark, kept, SF)
    got = {r.doc_id for r in near.collect()}
    sets = {}
    for r in kept.collect():
        w = ("".join(c.lower() if "A" <= c <= "Z" else c for c in r.text or "")).encode().split()
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()
    close = [(a, b) for a in sets for b in sets if a > b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    low = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a, b in close:
            if low[a] != low[b]:
                low[a] = low[b] = min(low[a], low[b])
                changed = True
    assert got == set(low.values()) and 9002 not in got
    cut = c.materialise(c.substrings(spark, c.materialise(near), SF))
    assert cut.columns == list(c.COLUMNS) and cut.where("n_chars != char_length(text)").count() == 0
    mixed = c.materialise(c.mix(spark, cut, SF))
    assert mixed.columns == list(c.COLUMNS)
    sizes, taken = ({r.source: r.n for r in d.groupBy("source").agg(F.sum(mixing.words("text")).alias("n")).collect()} for d in (cut, mixed))
    assert abs(sum(taken.values()) - 1.5 * sum(sizes.values())) <= len(sizes)
    coded = c.tokens(spark, mixed, SF)
    assert coded.count() == mixed.count() and coded.where("n_tokens = 0 and ids is null").count() == 0
    assert queries.table(spark, SF, "documents").count() == len(rows)
