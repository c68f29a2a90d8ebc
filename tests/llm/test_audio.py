import hashlib
from collections import Counter
from dataclasses import replace

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import audio
from tidemark.llm.queries import op4_chroma

FORM = audio.Format(rate=8000, frame=256, hop=64, bits=8, low=100.0, high=3600.0)
WIDE = audio.Format()


def tune(seed, seconds, rate=11025):
    rng = np.random.default_rng(seed)
    notes = rng.integers(0, 24, int(seconds * 4))
    t = np.arange(rate // 4) / rate
    return np.concatenate([np.sin(2 * np.pi * 220 * 2 ** (n / 12) * t) + 0.4 * np.sin(2 * np.pi * 440 * 2 ** (n / 12) * t) for n in notes])


def pcm(wave):
    return np.clip(wave * 12000, -32768, 32767).astype("<i2").tobytes()


def brute_codes(recording, form):
    """Filters by plain sums over each window."""
    sound = form.samples(recording)
    n = max(0, (len(sound) - form.frame) // form.hop + 1)
    image = audio.chroma(sound, form.hop * np.arange(n), form)
    fixed = np.rint(image * (1 << 20)).astype(np.int64)
    out = []
    for t in range(n - audio.SPAN + 1):
        code = 0
        for kind, y, h, w in audio.FILTERS:
            win = fixed[t : t + w, y : y + h]
            part = {"time": win[: w // 2], "pitch": win[:, : h // 2], "middle time": win[w // 3 : 2 * (w // 3)], "middle pitch": win[:, h // 3 : 2 * (h // 3)]}.get(kind)
            total = int(win[: w // 2, : h // 2].sum() + win[w // 2 :, h // 2 :].sum()) if part is None else int(part.sum())
            ratio = np.log((1024.0 + (2 if "middle" in kind else 1) * total) / (1024.0 + int(win.sum()) - total))
            code = code << 2 | [0, 1, 3, 2][sum(ratio >= c for c in audio.CUTS)]
        out.append(code)
    return out


def test_codes_against_plain_sums():
    texts = [b"", b"short", bytes(range(256)) * 9, ("Some words of prose, " * 150).encode(), b"\0" * 3000]
    got = audio.fingerprint_all(texts, FORM)
    assert [g.tolist() for g in got] == [brute_codes(t, FORM) for t in texts]
    assert audio.fingerprint_all([], FORM) == []


def test_real_sound_survives_noise_and_volume():
    wave = tune(1, 20)
    noisy = 0.6 * wave + 0.05 * np.random.default_rng(2).standard_normal(len(wave))
    clean, same, other = audio.fingerprint_all([pcm(wave), pcm(noisy), pcm(tune(3, 20))], WIDE)
    n, bits = audio.bit_error(clean, same, 0)
    assert n == len(clean) > 100 and bits / 32 / n < 0.15
    n, bits = audio.bit_error(clean, other, 0)
    assert bits / 32 / n > 0.3
    late = audio.fingerprint_all([pcm(wave[WIDE.hop * 10 :])], WIDE)[0]
    assert audio.bit_error(clean, late, 10) == (len(late), 0)


def brute_search(rows, form, is_query, votes=2, overlap=8, errors=0.35):
    prints = [(i, tuple(x.view(np.int32).tolist())) for (i, r) in rows for x in [audio.fingerprint_all([r or b""], form)[0]]]
    least = {}
    for i, p in prints:
        if p and i is not None:
            least[p] = min(i, least.get(p, i))
    asking = {p for i, p in prints if p and i is not None and is_query(i)}
    ints = {p: np.array(p, dtype=np.int64) for p in least}
    seeds = {c: [((int(x[k]), int(x[k + 1])), k) for k in range(len(x) - 1) if k == 0 or x[k] != x[k - 1]] for c, x in ints.items()}
    best = {}
    for q in asking:
        for d in ints:
            hits = Counter(a - b for key, a in seeds[q] for other, b in seeds[d] if key == other) if q != d else {}
            if hits:
                shift = min(hits, key=lambda s: (-hits[s], abs(s), s))
                n, bits = audio.bit_error(ints[q].astype(np.int32), ints[d].astype(np.int32), shift)
                if hits[shift] >= votes and n >= overlap and bits / 32 / n <= errors:
                    best.setdefault(d, []).append((bits / 32 / n, -n, least[q], shift))
    out = []
    for i, p in prints:
        c = least.get(p)
        own = best.get(p, [])
        top = min(own) if own else (None, None, None, None)
        out.append((i, c, len(p), hashlib.sha256(",".join(map(str, p)).encode()).hexdigest(), len(own), top[2], top[3], top[0]))
    return sorted(out, key=repr)


def test_search_against_brute_force(spark):
    base = [(f"Line {k} of a text that is long enough to give some frames, " * 40 + "".join(chr(97 + (k * j) % 26) for j in range(900))).encode() for k in range(6)]
    rows = [(10 * k, b) for k, b in enumerate(base)] + [(100 + k, b[64 * 3 :]) for k, b in enumerate(base)] + [(200, base[0]), (200, base[0]), (0, base[1]), (None, base[2]), (7, None), (8, b""), (9, b"x" * 5000), (50, b"y" * 5000), (300, base[3] + base[4])]
    media = spark.createDataFrame([(i, r, "c", 1) for i, r in rows], "doc_id long, pcm binary, class_id string, ints int")
    got = audio.search(media, "doc_id", "pcm", F.col("doc_id") % 50 == 0, FORM)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_search(rows, FORM, lambda i: i % 50 == 0)
    assert audio.search(media.limit(0), "doc_id", "pcm", F.col("doc_id") % 50 == 0, FORM).count() == 0


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = op4_chroma(spark, sf).collect()
    assert sorted(map(tuple, got), key=repr) == brute_search(rows, replace(FORM, least=8), lambda i: i % 50 == 0)
    copies = {}
    for r, (_, text) in zip(sorted(got), sorted(rows)):
        assert (r.class_id is None) == (not text) and (not text or r.n_ints >= 8)
        assert copies.setdefault(text, r.class_id) == r.class_id


def test_short_recordings_are_played_again():
    form = replace(FORM, least=8)
    short = b"a few bytes only"
    (own,) = audio.fingerprint_all([short], form)
    needed = form.frame + form.hop * (audio.SPAN + 6)
    assert len(own) == 8 and own.tolist() == audio.fingerprint_all([(short * 200)[:needed]], FORM)[0].tolist()
    assert [len(x) for x in audio.fingerprint_all([b"", b"x" * needed], form)] == [0, 8]


def test_a_key_that_many_share_is_split(spark, monkeypatch):
    rows = [(k, b"\x80" * 2000 + bytes((k * j * j) % 251 for j in range(2500)) + b"\x80" * 500) for k in range(40)]
    media = spark.createDataFrame(rows, "doc_id long, pcm binary")
    monkeypatch.setattr(audio, "HOT", 5)
    got = audio.search(media, "doc_id", "pcm", F.col("doc_id") % 10 == 0, FORM)
    want = brute_search(rows, FORM, lambda i: i % 10 == 0)
    assert sorted(map(tuple, got.collect()), key=repr) == want and any(r[4] for r in want)


def test_recordings_handled_together_are_bounded(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(audio, "BYTES", 10)
    column = pa.array([b"a" * 4, None, b"b" * 7, b"c" * 30, b"", b"d" * 10], pa.binary())
    runs = list(audio._together(column))
    assert runs == [(0, 2), (2, 1), (3, 1), (4, 2)] and list(audio._together(column.slice(0, 0))) == []


def test_recall_against_all_shifts(spark):
    """Noisy, quieter and cut copies of tunes: every alignment that all shifts give, with half a recording in common."""
    rng = np.random.default_rng(5)
    rows = []
    for k in range(8):
        wave = tune(20 + k, 12)
        rows.append((50 * k, pcm(wave)))
        for j in range(4):
            cut = wave[WIDE.hop * int(rng.integers(0, 25)) + int(rng.integers(0, 40)) :]
            rows.append((50 * k + 1 + j, pcm((0.4 + 0.2 * j) * cut + 0.01 * rng.standard_normal(len(cut)))))
    prints = {i: p.view(np.int32) for i, p in zip([i for i, _ in rows], audio.fingerprint_all([r for _, r in rows], WIDE))}
    want = set()
    for a in (i for i in prints if i % 50 == 0):
        for b in (i for i in prints if i != a):
            for shift in range(-len(prints[b]), len(prints[a])):
                n, bits = audio.bit_error(prints[a], prints[b], shift)
                if n >= 30 and bits <= 0.2 * 32 * n:
                    want.add((a, b))
    got = audio.search(spark.createDataFrame(rows, "doc_id long, pcm binary"), "doc_id", "pcm", F.col("doc_id") % 50 == 0, WIDE)
    found = {(r.best_query, r.doc_id) for r in got.collect() if r.n_links}
    assert len(want) >= 30 and len(want & found) >= 0.9 * len(want)
