"""License scans: exact, edited, short, long."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest

from carepath.llm.license_texts import TEMPLATES
from carepath.llm.licenses import Index, Winnow, aligned, scan_licenses
from carepath.llm.words import blocks

FILLER = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore"


def scan(spark, texts):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, license string")
    return scan_licenses(docs).collect()


@pytest.mark.parametrize("name", sorted(TEMPLATES))
def test_each_template_is_found_whole(spark, name):
    text = f"{FILLER}\n{TEMPLATES[name]}\n{FILLER}"
    found = scan(spark, [text])
    assert [r["license"] for r in found] == [name]
    first, n = len(FILLER.split()), len(TEMPLATES[name].split())
    assert (found[0]["start"], found[0]["end"], found[0]["coverage"]) == (first, first + n, 1.0)


def test_edits_case_and_punctuation(spark):
    changed = TEMPLATES["MIT"].upper().replace("SUBLICENSE", "RELICENSE").replace("FREE OF CHARGE,", "").replace(",", " ;")
    found = scan(spark, [f"{FILLER} {changed}", TEMPLATES["MIT"][: len(TEMPLATES["MIT"]) // 2]])
    assert [(r["doc_id"], r["license"]) for r in found] == [(0, "MIT")]
    assert 0.95 < found[0]["coverage"] < 1


def test_several_licenses_and_repeats(spark):
    text = " ".join([TEMPLATES["MIT statement"], FILLER, TEMPLATES["MIT statement"], TEMPLATES["Apache-2.0 notice"]])
    found = scan(spark, [text])
    assert [r["license"] for r in sorted(found, key=lambda r: r["start"])] == ["MIT statement", "MIT statement", "Apache-2.0 notice"]


def test_nothing_to_find(spark):
    assert scan(spark, [None, "", "a", FILLER, "the license of the software is provided to you"]) == []
    assert scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_text_is_scanned_to_its_end(spark):
    found = scan(spark, [f"{FILLER} " * 20_000 + TEMPLATES["ISC"]])
    assert [(r["license"], r["start"]) for r in found] == [("ISC", 15 * 20_000)]


def test_own_templates(spark):
    docs = spark.createDataFrame([(1, "x one two three four five y")], "doc_id long, text string")
    assert scan_licenses(docs, {"own": "one two three four five"}).first()["coverage"] == 1.0
    with pytest.raises(ValueError):
        Index({"short": "one two"}, Winnow())


def test_a_short_statement_and_copies_side_by_side(spark):
    plain, mit = "All rights reserved.", TEMPLATES["MIT statement"]
    found = scan(spark, [f"{FILLER}\n{plain}\n{FILLER}", f"{mit} {mit} {mit}", f"{plain} {plain} x {plain}", f"{mit} x {mit.replace('the', 'an')}"])
    spans = [(r["doc_id"], r["license"].split()[0], r["start"], r["end"]) for r in sorted(found, key=lambda r: (r["doc_id"], r["start"]))]
    n = len(FILLER.split())
    wanted = [(0, "All", n, n + 3), *[(1, "MIT", 5 * i, 5 * i + 5) for i in range(3)], (2, "All", 0, 3), (2, "All", 3, 6), (2, "All", 7, 10)]
    assert spans == [*wanted, (3, "MIT", 0, 5), (3, "MIT", 6, 11)]


def test_license_lines_of_the_generated_documents(spark):
    """Every line that is a statement by itself is found where it stands."""
    folded = {" ".join(t.lower().split()): k for k, t in TEMPLATES.items()}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    docs = docs.filter("text rlike '(?i)licen[sc]ed? |rights reserved'")
    wanted = set()
    for r in docs.collect():
        at = 0
        for line in r["text"].split("\n"):
            name = folded.get(" ".join(line.lower().split()))
            wanted |= {(r["doc_id"], name, at, at + len(line.split()))} if name else set()
            at += len(line.split())
    found = {(r["doc_id"], r["license"], r["start"], r["end"]) for r in scan_licenses(docs).collect()}
    assert "All rights reserved statement" in {w[1] for w in wanted}
    assert wanted <= found


def plain(template, words, low, high):
    """The alignment cell by cell."""
    width, above, result = high - low + 1, [(0, -1)] * (high - low + 2), (0, -1, 0)
    for i, word in enumerate(template):
        row, left = [], (0, -1)
        for d in range(width):
            j = i + low + d
            cell = max(left, above[d + 1])
            if 0 <= j < len(words) and words[j] == word:
                before = above[d]
                cell = max(cell, (before[0] + 1, before[1] if before[0] else j))
                if cell[:2] > result[:2]:
                    result = (*cell, j)
            row.append(cell)
            left = cell
        above = [*row, row[-1]]
    return (result[0], max(result[1], 0), result[2])


def edited(draw, words, share):
    out = []
    for word in words:
        kind = draw.random() / share
        out += [word] if kind >= 1 else ["zzz"] if kind < 0.4 else [] if kind < 0.7 else [word, "zzz"]
    return out


def test_alignment_equals_one_cell_by_cell():
    draw = random.Random(4)
    for _ in range(300):
        template = np.array([draw.randrange(12) for _ in range(draw.randrange(1, 25))])
        words = np.array([draw.randrange(12) for _ in range(draw.randrange(0, 40))], np.int64)
        low = draw.randrange(-20, 20)
        high = low + draw.randrange(0, 25)
        assert aligned(template, words, low, high) == plain(template.tolist(), words.tolist(), low, high)


def test_edited_copies_equal_a_search_without_the_index(spark):
    draw = random.Random(8)
    texts, wanted = [], []
    # words of a statement of five words lie about in any longer notice, so a search over all diagonals finds no copies of it
    own = {k: v for k, v in TEMPLATES.items() if k in ("MIT", "ISC", "Apache-2.0 notice")}
    clean = lambda word: word.lower().strip(".,;:()\"'")
    for name, text in own.items():
        for share in (0.02, 0.1, 0.3, 0.6):
            words = edited(draw, text.split(), share)
            texts.append(" ".join([*FILLER.split(), *words, *FILLER.split()]))
            found = [clean(w) for w in texts[-1].split()]
            counts = {}
            for other, template in own.items():
                parts = [clean(w) for w in template.split()]
                counts[other] = plain(parts, found, -len(parts), len(found))[0], len(parts)
            best = max(((m, other) for other, (m, n) in counts.items() if m >= 0.8 * n), default=None)
            wanted.append(best)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: (r["matched"], r["license"]) for r in scan_licenses(docs, own).collect()}
    assert [rows.get(i) for i in range(len(texts))] == wanted
    assert any(w is None for w in wanted) and sum(w is not None for w in wanted) >= 6


def test_hundreds_of_copies_in_one_text(spark):
    draw = random.Random(2)
    text, n = TEMPLATES["MIT"], len(TEMPLATES["MIT"].split())
    some = " ".join([text] * 400)
    started = time.monotonic()
    index = Index(TEMPLATES)
    spans = [m for _, _, texts in blocks(pa.array([some])) for _, m in index.matches(texts)]
    assert time.monotonic() - started < 10
    assert [(m[0], m[1], m[2]) for m in spans] == [("MIT", i * n, (i + 1) * n) for i in range(400)]
    # with nothing between edited copies an alignment may take a word of the next one, which is then lost (59 of these 60)
    mixed = f" {FILLER} ".join(" ".join(edited(draw, text.split(), 0.02)) for _ in range(60))
    found = scan(spark, [mixed])
    assert len(found) == 60 and {r["license"] for r in found} == {"MIT"} and min(r["coverage"] for r in found) > 0.9
