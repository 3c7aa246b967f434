"""The pipeline against plain versions of its deciding stages, on a small fixture."""

import numpy as np
import pytest
from test_jaccard import naive_components
from test_lines import naive_dedup
from tokenizers import Tokenizer

import corpus_pipeline
from spinledger.llm import langid, quality
from spinledger.llm.queries import table, tokenizer_path

LABELS = "doc_id bigint, quality int, toxic int"


def texts(made):
    words = {"en": "the of and tion with have ing her water".split(), "de": "der und schein keit ich nicht ung ver".split()}
    shared = "\n".join(" ".join(made.choice(words["en"], 9)) for _ in range(4))
    for i in range(160):
        lang = "en" if i % 2 else "de"
        lines = [" ".join(made.choice(words[lang], 8)) + "." for _ in range(4)]
        if i % 7 == 3:
            yield i, "\n".join(lines).upper().replace(" ", "!! ") + " $$$ %%% &&&", lang
        elif i % 11 == 5:
            yield i, shared + "\n" + "\n".join(lines), lang
        else:
            yield i, "\n".join(lines), lang
    base = [" ".join(made.choice(words["en"], 40)) + "." for _ in range(4)]
    for i in range(160, 172):
        first, second = made.choice(words["en"], 2)
        yield i, "\n".join([base[0], f"{first} {i % 4 * 'the '}{base[1]}", f"{second} {i % 5 * 'of '}{base[2]}", base[3]]), "en"
    yield 180, "1234 5678 ...", "en"
    yield 181, "", "de"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    made, out = np.random.default_rng(1), tmp_path_factory.mktemp("tables")
    rows = [(i, t, lang, f"s{i % 3}", len(t)) for i, t, lang in texts(made)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{out}/documents.parquet")
    labels = [(i, int(i % 7 != 3 or i >= 160), 0) for i, *_ in rows if i < 172 and i % 3]
    spark.createDataFrame(labels, LABELS).write.parquet(f"{out}/labels.parquet")
    return str(out)


def test_stages_decide_like_plain_versions(spark, folder):
    docs = table(spark, folder, "documents")
    before = docs.columns
    stages = dict(corpus_pipeline.STAGES)

    kept = stages["language_id"](spark, docs, folder)
    vocabulary = tokenizer_path("piece_bpe_32k.model")
    told = {r.doc_id: r for r in langid.identify(docs, vocabulary).collect()}
    assert {r.doc_id for r in kept.collect()} == {i for i, r in told.items() if r.lang_pred != "und" and r.score >= 0.5}
    assert not {180, 181} & {r.doc_id for r in kept.collect()}

    good = stages["quality_classifier"](spark, kept, folder)
    scored = quality.score_documents(kept, table(spark, folder, "labels")).collect()
    rows = good.collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in scored if r.keep}
    assert not any(r.doc_id < 160 and r.doc_id % 7 == 3 for r in rows) and len(rows) > 120

    lines = stages["line_dedup"](spark, good, folder)
    cut = [(i, t) for i, t, *_ in naive_dedup([(r.doc_id, r.text) for r in rows])]
    assert sorted((r.doc_id, r.text) for r in lines.collect()) == cut
    assert all(r.n_chars == len(r.text) for r in lines.collect())

    one = stages["ngram_jaccard"](spark, lines, folder)
    first = {i for i, c in naive_components(cut).items() if i == c}
    assert {r.doc_id for r in one.collect()} == first
    assert first & set(range(160, 172)) and len(first & set(range(160, 172))) < 6

    for df in (kept, good, lines, one):
        assert df.columns == before
    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    last = {i: t for i, t in cut if i in first}
    pieces = corpus_pipeline.run(spark, folder).collect()
    sizes = {}
    for r in pieces:
        sizes[r.doc_id] = sizes.get(r.doc_id, 0) + r.length
    assert sizes == {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in last.items()}


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels"):
        table(spark, folder, name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
