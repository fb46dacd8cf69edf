"""Small tables with nulls, empty and repeated rows; results against brute force or the library."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from murmura.llm import bpe_automaton, chat_format, packing, quality_rules, token_counts, token_output
from murmura.llm.encoding import Pieces, pieces, word_tokenizer_path
from murmura.runtime import scratch_path

TEXTS = [None, "", "   ", "Hello, World! it's 12 o'clock", "a <|endoftext|> b", "x" * 3000,
         "Ünï çödé é straße İ\x1c!", "the cat sat on the mat " * 40, "one two\none two\nthree",
         "Hello, World! it's 12 o'clock", "</s>[INST] \\ <s"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, start int"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i != 2 else None, t, "en" if i % 2 else None, "s", len(t or ""), "x", 1)
            for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows + [rows[3]], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def word_ids(text, end):
    library = Tokenizer.from_file(word_tokenizer_path())
    return library.encode(text or "", add_special_tokens=False).ids + [end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files_give_back_all_ids(spark, docs, none):
    path = scratch_path(spark, "ids")
    token_output.write_token_ids(docs, path)
    rows = token_output.token_index(spark, path).orderBy("start").collect()
    expected = sorted(((i if i != 2 else -1, t or "") for i, t in [*enumerate(TEXTS), (3, TEXTS[3])]))
    at = 0
    for row, (doc_id, text) in zip(rows, expected, strict=True):
        ids = word_ids(text, 1)
        assert (row.doc_id if row.doc_id is not None else -1, row.start, row.n_tokens, row.ids_crc32) == (
            doc_id, at, len(ids), crc(ids))
        at += len(ids)
    found = token_output.find_documents(spark, path, [5]).collect()
    assert [r.ids for r in found] == [word_ids(TEXTS[5], 1)]
    empty = scratch_path(spark, "ids")
    token_output.write_token_ids(none, empty)
    assert token_output.token_index(spark, empty).count() == 0


def test_packing_places_every_id_once(docs, none):
    rows = packing.pack_documents(docs, capacity=64, group_docs=5, with_ids=True).collect()
    pieces = Counter()
    for r in rows:
        assert r.length == len(r.ids) and crc(r.ids) == r.ids_crc32
        pieces[r.doc_id, r.start] += 1
    assert pieces[3, 0] == 2
    for i, text in enumerate(TEXTS):
        own = sorted((r.start, r.ids) for r in rows if r.doc_id == (i if i != 2 else None))
        if i != 3:
            assert sum((ids for _, ids in own), []) == word_ids(text, 2)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack_documents(none).count() == 0


def test_first_fit_decreasing_takes_the_first_bin_with_room():
    lengths = np.array(sorted(np.random.default_rng(1).integers(1, 65, 200), reverse=True))
    bins, _ = packing.first_fit_decreasing(lengths, 64)
    room = []
    for item, found in zip(lengths, bins):
        first = next((i for i, r in enumerate(room) if r >= item), len(room))
        if first == len(room):
            room.append(64)
        room[first] -= item
        assert first == found


def test_automaton_equals_the_library(docs, none):
    library = Tokenizer.from_file(bpe_automaton.byte_tokenizer_path())
    for r in bpe_automaton.encode_documents(docs).collect():
        text = TEXTS[r.doc_id if r.doc_id is not None else 2] or ""
        ids = library.encode(text, add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == library.decode(ids, skip_special_tokens=False)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert bpe_automaton.encode_documents(none).count() == 0


def test_context_limits_equal_sums_over_documents(docs, none):
    lengths = [len(word_ids(t, 1)) - 1 for t in [*TEXTS, TEXTS[3]]]
    limits = token_counts.context_limits(token_counts.length_histogram(docs))
    for r in limits.collect():
        assert r.docs_cut == sum(n > r.context_limit for n in lengths)
        assert r.truncated_total == sum(min(n, r.context_limit) for n in lengths)
        assert r.quantile == sum(n <= r.context_limit for n in lengths) / len(lengths)
    assert token_counts.truncated_total(limits, 17).first()[0] == sum(min(n, 17) for n in lengths)
    assert token_counts.context_limits(token_counts.length_histogram(none)).count() == 0


def test_base_features_equal_plain_python(docs, none):
    for r in quality_rules.features(docs).collect():
        text = TEXTS[r.doc_id if r.doc_id is not None else 2] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
        often = Counter(windows)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (
            len(words), sum(map(len, words)), len(lines) - len(set(lines)),
            len({i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(8)}))
    assert quality_rules.features(none).count() == 0


def test_cutoffs_keep_the_binomial_bound(spark):
    rows = spark.createDataFrame(
        [("en", 1, 0.001 if i % 3000 else 0.3, 0.0, 0.0, 0.0, 5.0) for i in range(6000)],
        "lang string, quality int, symbol_rate double, dup_line_rate double, upper_rate double, "
        "mark_rate double, long_word_mean double")
    found = {r.rule: r.cutoff for r in quality_rules.choose_cutoffs(rows).collect()}
    assert found["symbol_rate"] == 0.01  # 2 of 6000 rejected: below a fifth of 1 % beyond doubt
    few = quality_rules.choose_cutoffs(rows.limit(50))
    assert few.count() == 0  # 50 labels can't bear out 1 %


def test_all_rules_of_a_stratum_keep_the_bound_together(spark):
    """Each rule rejects another 1/120 of the good rows: fine alone, too much together."""
    names = list(quality_rules.RULES)
    rows = [("en", 1, *[100.0 if i % 120 == j else 0.0 for j in range(len(names))]) for i in range(20_000)]
    good = spark.createDataFrame(rows, "lang string, quality int, " + ", ".join(f"{n} double" for n in names))
    cutoffs = quality_rules.choose_cutoffs(good)
    judged = quality_rules.apply_rules(good.withColumn("base_failed", F.lit(False)), cutoffs, names)
    assert judged.filter("not kept").count() <= 0.01 * len(rows)


def test_binomial_tail_is_exact(spark):
    from math import comb, log
    for n, k in ((50, 0), (200, 3), (500, 4)):
        exact = log(sum(comb(n, i) * 0.01 ** i * 0.99 ** (n - i) for i in range(k + 1)))
        got = spark.range(1).select(quality_rules.log_binomial_cdf(
            F.lit(k).cast("long"), F.lit(n).cast("long"), 0.01)).first()[0]
        assert abs(got - exact) < 1e-9


def test_chat_texts_come_back(spark):
    odd = ["</s>[INST] ok [/INST]", "\\", "[\\INST]", "<", "<<SYS>> <|end|>", "a\\\\</s>", None, "x\ny"]
    turns = [(1, i, ("user", "assistant")[i % 2], t) for i, t in enumerate(odd)]
    turns += [(2, 0, "tool|>[INST]", "z"), (2, 1, None, "</s>"), (None, 0, "system", "s"), (3, 0, "user", "q"),
              (3, 1, "assistant", "a"), (3, 2, "user", "q")]
    rows = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    found = {r.conv_id: r for r in chat_format.format_conversations(rows).withColumn(
        "back", chat_format.read_back(F.col("formatted"))).collect()}
    for conv, r in found.items():
        own = [(t[2] or "", t[3] or "") for t in turns if t[0] == conv]
        assert [(b.role, b.text) for b in r.back] == own
        assert "".join(s.text for s in r.segments) == r.formatted
    assert found[1].valid_order and not found[2].valid_order and found[3].first_bad_turn == 3
    assert chat_format.digests(chat_format.format_conversations(rows.limit(0))).count() == 0


def test_pieces_are_forgotten_beyond_the_number_to_keep():
    known, text = pieces(word_tokenizer_path(), 3), "one two three four, five six one Two seven. eight nine ten"
    want = known.library.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(known.encode(text), "<u4").tolist() == want
    assert len(known) <= 4 and len(known.older) <= 4


def test_marked_words_are_made_from_plain_words():
    known = Pieces(word_tokenizer_path(), 1000)
    words = [f"{a}{b}word" for a in "abcde" for b in "klmn"]
    text = " ".join(f"{w}{m}" for w, m in zip(words, ["$$$", "&&&", "***", "###", ".***"] * 4))
    assert np.frombuffer(known.encode(text.title()), "<u4").tolist() == word_ids(text, 0)[:-1]
    # Rare words are held once, not with each of their marks and capitals too.
    assert set(known) == {*words, "$$$", "&&&", "***", "###", ".***"}


def test_pieces_of_random_marks_equal_the_library():
    rng = np.random.default_rng(5)
    parts = ["the", "Café", "İ", "ÀÉ", "don't", "'s", "'", "$$", "***", "<|endoftext|>", "|>", "<|", ">", "=",
             "̸", "́", "12", ".", ",", "(", ")", "_", "`", "—", " ", " ", " ", "\x0b", "漢", "Σ"]
    known, library = Pieces(word_tokenizer_path(), 9), Tokenizer.from_file(word_tokenizer_path())
    for _ in range(3000):
        text = "".join(rng.choice(parts, 12))
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(known.encode(text), "<u4").tolist() == want, repr(text)
