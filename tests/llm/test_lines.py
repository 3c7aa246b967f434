"""Line dedup and licence scans on small tables, against brute force."""

import random
import re

from spinledger.llm import licenses, line_dedup

SCHEMA = "doc_id bigint, text string, n_lines string, starts int, best string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "x", 7, "y") for i, t in rows], SCHEMA)


def naive_dedup(rows):
    seen, out = set(), []
    for i, text in sorted(rows):
        lines, gone = text.split("\n"), set()
        for k in range(len(lines) - 2):
            window = tuple(lines[k : k + 3])
            if window in seen:
                gone |= {k, k + 1, k + 2}
            seen.add(window)
        out.append((i, "\n".join(x for k, x in enumerate(lines) if k not in gone), len(lines), len(gone)))
    return out


def test_line_dedup_matches_brute_force(spark):
    made = random.Random(3)
    rows = [(i, "\n".join(made.choice("abcde") for _ in range(made.randint(0, 12)))) for i in range(120)]
    rows += [(200 + i, "p\nq\nr\nown %d\nx" % i) for i in range(40)]
    found = line_dedup.dedup_lines(docs_of(spark, rows)).select("doc_id", "text", "n_lines", "n_removed").orderBy("doc_id").collect()
    assert [tuple(r) for r in found] == naive_dedup(rows)


def test_line_dedup_edges(spark):
    rows = [(None, "a\nb\nc"), (1, None), (2, ""), (3, "a\nb\nc"), (3, "a\nb\nc"), (4, "a\nb\nc\nd"), (5, "x\n" * 5)]
    result = line_dedup.dedup_lines(docs_of(spark, rows))
    assert result.columns == ["doc_id", "text", "starts", "best", "n_lines", "n_removed"]
    found = sorted(((r.doc_id or 0, r.text, r.n_removed) for r in result.collect()), key=str)
    expected = [(0, "a\nb\nc", 0), (1, None, 0), (2, "", 0), (3, "a\nb\nc", 0), (3, "a\nb\nc", 0), (4, "d", 3), (5, "x\n", 4)]
    assert found == [*expected[:6], (5, "x\n", found[6][2])] and found[6][2] in (3, 4)
    assert line_dedup.dedup_lines(docs_of(spark, [])).count() == 0


def naive_scan(text, threshold):
    def grams(part):
        words = re.findall(r"[^\W_]+", part.lower())
        return set(zip(words, words[1:]))

    lines = text.split("\n")
    for line, part in ([(-1, text)] if len(lines) > 1 else []) + list(enumerate(lines)):
        own = grams(part)
        scored = []
        for name, template in licenses.TEMPLATES.items():
            other = grams(template)
            scored.append((-2 * len(own & other) / (len(own) + len(other)), name, len(own & other)))
        if -min(scored)[0] >= threshold:
            yield line, min(scored)[1], -min(scored)[0], min(scored)[2]


def test_license_scan_matches_brute_force(spark):
    made = random.Random(8)
    rows = []
    for i in range(60):
        words = made.choice(list(licenses.TEMPLATES.values())).split()
        for _ in range(made.randint(0, 3)):
            words[made.randrange(len(words))] = made.choice(["the", "x", "License", "LICENSE,"])
        lines = ["some words here and there", " ".join(words), "", "Ünd été 中文"]
        made.shuffle(lines)
        rows.append((i, "\n".join(lines[: made.randint(1, 4)])))
    rows.append((90, licenses.TEMPLATES["mit-grant"].replace(", ", ",\n")))
    found = licenses.scan_licenses(docs_of(spark, rows)).collect()
    expected = sorted((i, *row) for i, text in rows for row in naive_scan(text, 0.8))
    assert sorted(tuple(r) for r in found) == expected and any(r.line == -1 for r in found)


def test_license_scan_edges(spark):
    mit = "released UNDER the *MIT* license"
    rows = [(None, mit), (1, None), (2, ""), (3, mit), (3, mit), (4, "word")]
    found = licenses.scan_licenses(docs_of(spark, rows)).collect()
    assert sorted((r.doc_id or 0, r.license, r.dice) for r in found) == [(0, "mit", 1.0), (3, "mit", 1.0), (3, "mit", 1.0)]
    assert licenses.scan_licenses(docs_of(spark, [])).count() == 0
    assert licenses.scan_licenses(docs_of(spark, rows), {"none": "word"}).count() == 0


def test_license_scan_finds_wrapped_and_embedded_passages(spark):
    words = licenses.TEMPLATES["apache-2.0-header"].split()
    header = "\n".join(f"# {' '.join(words[k : k + 9])}" for k in range(0, len(words), 9))
    code = "\n".join(f"value_{i} = compute(alpha_{i}, beta_{i}) + offset_{i}" for i in range(40))
    mit = licenses.complete_texts()["mit-text"]
    rows = [
        (1, f"intro words here\n{header}\n{code}"),
        (2, "Some text here. Released under the MIT License. And then more text follows on the line."),
        (3, mit),
        (4, f"{code}\n{mit}\n{code}\n{licenses.TEMPLATES['mit']}"),
        (5, f"{code}\nThis work is licensed under the GNU\nGeneral Public License, version 3. {code}"),
        (6, "Released under no License; the MIT is a school."),
    ]
    found = sorted((r.doc_id, r.line, r.license, round(r.dice, 2)) for r in licenses.scan_texts(docs_of(spark, rows)).collect())
    assert (1, 1, "apache-2.0-header", 1.0) in found
    assert [r for r in found if r[0] == 2] == [(2, 0, "mit", 1.0)]
    assert [r for r in found if r[0] == 3 and r[1] == -1] == [(3, -1, "mit-text", 1.0)]
    own = [r for r in found if r[0] == 4]
    assert own == [(4, 42, "mit-text", 1.0), (4, 100, "mit", 1.0)]  # the file begins with two empty lines
    assert [r for r in found if r[0] == 5] == [(5, 40, "gpl-3.0", 1.0)]
    assert not [r for r in found if r[0] == 6]


def test_license_scan_drops_texts_without_anchors_and_no_match(spark):
    words = licenses.TEMPLATES["gpl-2.0"].split()
    rows = [(1, "plain words of no licence\nand more of them"), (2, None), (3, ""), (None, licenses.TEMPLATES["mit"])]
    rows += [(10 + i, "\n".join(["Some text", " ".join(words[i:] + ["x"] * (i % 2)), "more"])) for i in range(6)]
    rows += [(20, "a b\n" + licenses.TEMPLATES["unlicense"].replace(" ", "\n") + "\nc d")]
    texts = licenses.TEMPLATES | licenses.complete_texts()
    kept = licenses.possible_texts(docs_of(spark, rows), texts)
    assert not {1, 2, 3} & {r.doc_id for r in kept.collect()}
    docs = docs_of(spark, rows)
    apart = licenses.scan_licenses(docs, texts).unionByName(licenses.scan_passages(docs, texts))
    found = licenses.scan_texts(docs)
    order = lambda frame: sorted(map(str, frame.collect()))
    assert order(found) == order(apart) and any(r.doc_id == 20 for r in found.collect())
