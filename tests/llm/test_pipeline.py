"""The pipeline's stages and the whole against plain Python, on planted documents."""

import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from annalist.llm import byte_bpe

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "extra"]


def prose(rng, n, mark="w"):
    return " ".join(f"{mark}{rng.randrange(4000)}" + ("." if rng.random() < 0.1 else "") for _ in range(n))


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    """(folder, texts by id, what each stage is to do)."""
    folder = str(tmp_path_factory.mktemp("world"))
    rng = random.Random(77)
    texts = {i: prose(rng, 60) for i in range(300)}
    toxic = set(range(0, 300, 5))
    for i in toxic:
        words = texts[i].split()
        words[10:13] = [f"vile{rng.randrange(4)}" for _ in range(3)]
        texts[i] = " ".join(words)
    labels = [(i, 1, int(i in toxic)) for i in range(250)]
    # A group of a text, its copy and a near copy; a shared passage; one and two benchmark items.
    texts[301] = prose(rng, 80)
    texts[302] = texts[301]
    texts[303] = texts[301] + " and more"
    passage = prose(rng, 60, "p")
    texts[304], texts[305] = f"{prose(rng, 40)}. {passage}. {prose(rng, 40)}", f"{prose(rng, 40)}. {passage}. {prose(rng, 40)}"
    items = [prose(rng, 12, "b").replace(".", "") for _ in range(2)]
    texts[306], texts[307] = f"{prose(rng, 30)} {items[0]} {prose(rng, 30)}", f"{prose(rng, 30)} {items[0]} {prose(rng, 30)} {items[1]}"
    texts[308], texts[309] = None, ""
    rows = [(i, t, "en", "s", None if t is None else len(t), "e") for i, t in texts.items()] + [(None, prose(rng, 30), None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, extra string"
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([*labels, (None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([("i0", items[0]), ("i1", items[1]), ("i2", None)], "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, texts, toxic, passage, items


def by_id(df):
    assert df.columns == COLUMNS
    rows = df.collect()
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows if r.doc_id is not None)
    return {r.doc_id: r.text for r in rows}


def test_every_stage_and_the_whole(spark, world):
    folder, texts, toxic, passage, items = world
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{folder}/documents.parquet")

    kept = stages["toxicity"](spark, docs, folder)
    expected = {i for i in texts if i not in toxic} | {None}
    assert set(by_id(kept)) == expected

    kept = stages["ngram_jaccard_join"](spark, docs, folder)
    assert set(by_id(kept)) == (set(texts) | {None}) - {302, 303}

    cut = by_id(stages["substring_dedup"](spark, docs.where("doc_id NOT IN (302, 303) OR doc_id IS NULL"), folder))
    assert cut[304] == texts[304] and passage[60:-60] not in cut[305] and len(cut[305].split()) < 110
    assert all(cut[i] == texts[i] for i in texts if i not in (302, 303, 305)) and None in cut

    cut = by_id(stages["decontamination"](spark, docs, folder))
    assert 307 not in cut and cut[306] == texts[306].replace(" " + items[0], "")
    assert all(cut[i] == texts[i] for i in texts if i not in (306, 307)) and None in cut

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(public_tokenizers.path(byte_bpe.RANKS)), special_tokens={})
    got = {r.doc_id: np.frombuffer(r.tokens, "<u4").tolist() for r in stages["byte_bpe"](spark, docs, folder).collect()}
    assert {i: got[i] for i in texts} == {i: library.encode_ordinary(t or "") for i, t in texts.items()}

    out = {r.doc_id: library.decode(np.frombuffer(r.tokens, "<u4").tolist()) for r in corpus_pipeline.run(spark, folder).collect()}
    assert set(out) == ({i for i in texts if i not in toxic} | {None}) - {302, 303, 307}
    assert out[306] == texts[306].replace(" " + items[0], "") and passage[60:-60] not in out[305]
    assert all(out[i] == (texts[i] or "") for i in out if i not in (None, 305, 306))


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_of_an_empty_table(spark, world, name):
    folder = world[0]
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    assert dict(corpus_pipeline.STAGES)[name](spark, docs, folder).count() == 0
