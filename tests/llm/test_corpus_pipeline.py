"""The corpus pipeline against a plain version, and the guard of its queries."""

import re
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[2]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    en = "the quick brown fox jumps over the lazy dog and then it runs away from number "
    fr = "le renard brun saute par dessus le chien paresseux et puis il part au loin "
    rows = []
    for k in range(60):
        base = " ".join(f"{w}{k * 17 % 23 if i % 5 == 0 else ''}" for i, w in enumerate(((en if k % 2 else fr) * 3).split()))
        rows.append((k, f"{base} {k}", "en" if k % 2 else "fr", "src0" if k % 3 else "src1", 1))
    rows += [(100, rows[7][1], "en", "src0", 1), (101, rows[7][1], "en", "src0", 1), (102, None, "en", None, None), (103, "12 34", "fr", "s", 5), (104, en + "token = abcdefgh12345 and more", "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_stages_against_a_plain_version(spark, folder):
    import corpus_pipeline as C
    from answerloom.llm import langid, secretscan, simhash

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [name for name, _ in C.STAGES] == ["language_id", "near_duplicates", "secrets", "packing"]
    first = C.STAGES[0][1](spark, docs, folder)
    model = langid.load_model(langid.trained_model(docs))
    want = {r.doc_id for r in docs.collect() if model.predict(r.text)[0] != "und" and model.predict(r.text)[1] >= langid.KEEP_SCORE}
    assert {r.doc_id for r in first.collect()} == want and want >= set(range(60))
    rows = first.collect()
    second = C.STAGES[1][1](spark, first, folder)
    fps = {r.doc_id: simhash.fingerprint(r.text) for r in rows}
    kept = {i for i in fps if not any(j < i and (fps[i] ^ fps[j]).bit_count() <= 3 for j in fps)}
    assert {r.doc_id for r in second.collect()} <= set(fps) and {r.doc_id for r in second.collect()} == {min(c) for c in groups(fps)} and kept >= {min(c) for c in groups(fps)}
    third = C.STAGES[2][1](spark, second, folder)
    texts = {r.doc_id: r.text for r in third.collect()}
    assert secretscan.MARK in texts[104] and "abcdefgh12345" not in texts[104]
    assert len(texts) == second.count() and first.columns == second.columns == third.columns == docs.columns
    packed = C.run(spark, folder)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(texts)
    for sequence in packed.groupBy("sequence_id").sum("length").collect():
        n = sequence[1]
        assert n == 2048 or n & (n - 1) == 0


def groups(fps):
    left, out = set(fps), []
    while left:
        grow = [left.pop()]
        own = set(grow)
        while grow:
            x = grow.pop()
            near = {j for j in left if (fps[x] ^ fps[j]).bit_count() <= 3}
            left -= near
            own |= near
            grow += near
        out.append(own)
    return out


def test_every_operator_has_a_query():
    import __spark_entry__ as entry

    names = list(entry.queries())
    assert [n for n in names if re.match(r"op\d+_", n)] == sorted((n for n in names if re.match(r"op\d+_", n)), key=lambda n: int(n[2:].split("_")[0]))
    assert {int(n[2:].split("_")[0]) for n in names if re.match(r"op\d+_", n)} == set(range(1, 11)) and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)


def test_the_rest_works_without_this_part(tmp_path):
    import shutil

    shutil.copytree(ROOT / "answerloom", tmp_path / "answerloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import re, __spark_entry__ as e; q = e.queries(); assert q and not any(re.match(r'op[0-9]', n) or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


def test_nothing_else_imports_this_part():
    for path in (ROOT / "answerloom").rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"\bllm\b", path.read_text()), path
