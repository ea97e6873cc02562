import re
import textwrap

from tesserae.llm import license_scan as L

SCHEMA = "doc_id long, text string, license string, units string, norm string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "x", "x") for i, t in rows], SCHEMA)


def brute(text):
    norm = lambda s: [w for w in re.sub(r"[\W_]+", " ", s.lower()).split(" ") if w]
    grams = lambda w: set(zip(w, w[1:], strict=False))
    whole, hits = norm(text or ""), []
    units = [grams(norm(u)) for u in [*(text or "").split("\n"), (text or "").replace("\n", " ")]]
    for k, (name, t) in enumerate(L.TEMPLATES):
        h, n = grams(norm(t)), len(norm(t))
        windows = [grams(whole[i : i + n]) for i in range(len(whole) - 1) if (whole[i], whole[i + 1]) in h]
        score = max((2 * len(g & h) / (len(g) + len(h)) for g in units + windows if g), default=0)
        if score >= 0.8:
            hits.append((score, len(h), -k, name))
    return (max(hits)[3], max(hits)[0], len(hits)) if hits else (None, 0.0, 0)


def test_scan_matches_brute_force(spark):
    texts = [t for _, t in L.TEMPLATES] + ["Some words\n" + L.TEMPLATES[0][1].upper() + "\nmore words", None, "", "one", "\n\n", "Released, under the  MIT-License!", "Released under MIT license"]
    texts += ["LICENSED under the Apache License version 2.0\nThis work is licensed under the GNU General Public License, version 3.", "plain words only " * 50]
    half = L.TEMPLATES[2][1].split()
    texts += [" ".join(half[: len(half) * k // 10]) for k in range(1, 11)]
    wrapped = [textwrap.fill(t, 72) for _, t in L.TEMPLATES]
    prose = " ".join(f"word{i % 97}" for i in range(300))
    texts += [f"{prose}\n{t}\n{prose}" for t in wrapped] + [f"{prose} {L.TEMPLATES[0][1]} {prose}"]
    got = {r.doc_id: r for r in L.scan_licenses(frame(spark, [*enumerate(texts), (3, texts[3])])).collect()}
    for i, t in enumerate(texts):
        assert (got[i].license, round(got[i].score, 9), got[i].matches) == (brute(t)[0], round(brute(t)[1], 9), brute(t)[2]), t


def test_empty_table_and_no_templates(spark):
    assert L.scan_licenses(frame(spark, [])).collect() == []
    assert L.scan_licenses(frame(spark, [(1, "a b")]), templates=()).first().license is None


def test_wrapped_and_embedded_licences_are_found(spark):
    prose = " ".join(f"word{i % 97}" for i in range(300))
    texts = [f"{prose}\n\n{textwrap.fill(t, 70)}\n\n{prose}" for _, t in L.TEMPLATES]
    got = {r.doc_id: r for r in L.scan_licenses(frame(spark, enumerate(texts))).collect()}
    assert [got[k].license for k in range(len(texts))] == [name for name, _ in L.TEMPLATES]
    assert L.scan_licenses(frame(spark, [(1, "Released under the MIT License. Copyright 2020 Foo Bar Inc.")])).first().license == "MIT"


def test_very_long_text(spark):
    text = "some plain words " * 300_000 + L.TEMPLATES[2][1] + " more" * 200_000
    assert L.scan_licenses(frame(spark, [(1, text)])).first().license == "MIT"
