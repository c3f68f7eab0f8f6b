import zlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from clickweir.llm import tokens
from clickweir.session import scratch

ODD = ["", None, " \t\n", "Don't stop, it's <|endoftext|> now.", "İstanbul ΣΑΣ e\u0301 \u0301x a\u00a0b\u2003c", "日本語 テスト, a1b2 ...", "x" * 5000,
       "word, " * 3000, "<|startoftext|>a<|endoftext|>", "a\x00b \x1c c\x85d", "ok", "ok"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300) | st.integers(0, 70000), max_size=700))
def test_codes_round_trip(values):
    ids = np.array(values, np.uint32)
    dac = tokens.Dac(tokens.dac_encode(ids))
    assert len(dac) == len(values) and dac.all().tolist() == values
    assert [dac[i] for i in range(len(values))] == values


def test_access_across_rank_blocks():
    ids = np.random.default_rng(1).integers(0, 1 << 17, 20_000).astype(np.uint32)
    dac = tokens.Dac(tokens.dac_encode(ids))
    assert all(dac[i] == ids[i] for i in range(0, 20_000, 7))


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="ab', .'s!<|endoftext>é\u0301İ1\n\t", max_size=60))
def test_word_cache_equals_whole_texts(text):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    assert tokens.coder(path, False).direct
    got, counts = tokens.coder(path, False).encode(pa.array([text, "", text + " a"], pa.large_string()))
    assert got[:counts[0]].tolist() == tokens.coder(path, True).tokenizer.encode(text, add_special_tokens=False).ids


def test_files_hold_every_document(spark, docs, tokenizer):
    rows = [(i * 3, t) for i, t in enumerate(ODD)] + [(6, "again"), (None, "no id"), (6, "again")]
    path = tokens.write_tokens(spark, docs(rows), tokenizer, scratch(spark, "t"))
    got = tokens.read_tokens(spark, path).collect()
    model = Tokenizer.from_file(tokenizer)
    want = sorted(((-1 if k is None else k), np.array(model.encode(t or "", add_special_tokens=False).ids + [1], "<u4")) for k, t in rows if k != 6)
    plain = {(-1 if r["doc_id"] is None else r["doc_id"]): r for r in got if r["doc_id"] != 6}
    assert len(got) == len(rows)
    for key, ids in want:
        assert (plain[key]["n_tokens"], plain[key]["ids_crc32"]) == (len(ids), zlib.crc32(ids.tobytes()))
    ordered = sorted(got, key=lambda r: r["start"])
    assert [r["start"] for r in ordered] == np.cumsum([0] + [r["n_tokens"] for r in ordered])[:-1].tolist()
    assert [r["doc_id"] for r in ordered] == sorted((r["doc_id"] for r in got), key=lambda k: -1 if k is None else k)
    everything = tokens.token_slice(spark, path, 0, 10**6)
    assert tokens.token_slice(spark, path, 5, 40) == everything[5:45]
    last = ordered[-1]
    assert zlib.crc32(np.array(everything[last["start"]:], "<u4").tobytes()) == last["ids_crc32"]


def test_no_documents(spark, docs, tokenizer):
    assert tokens.documents_tokens(spark, docs([]), tokenizer).count() == 0


def test_the_model_is_asked_once_for_all_forms_of_a_word():
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    words, asked = tokens.WordCoder(path), []
    model = words.model

    class Asked:
        def tokenize(self, text):
            asked.append(text)
            return model.tokenize(text)
    words.model = Asked()
    texts = ["Lamp lamp LAMP, lamp.", " laMP! été, (lamp) a1 ", "", "lamp a1? ... Été"]
    for _ in range(2):
        got, counts = words.encode(pa.array(texts, pa.large_string()))
        want = [words.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert got.tolist() == sum(want, []) and counts.tolist() == list(map(len, want))
    assert len(asked) == 3 and asked.count("lamp") == 1    # lamp, été and Été
