import gc
import hashlib
import random
import tracemalloc

from helpers import clashing, documents, rows, saved
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from deltaloom.llm import bpe

PATH = bpe.tokenizer_path()
LIBRARY = Tokenizer.from_file(PATH)
LIBRARY.no_truncation()
LIBRARY.no_padding()


def expected(text):
    ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(ids), sha(" ".join(map(str, ids))), sha(LIBRARY.decode(ids, skip_special_tokens=False))


TEXTS = [
    None, "", "   ", "The theatre's don't 12 ½ ßẞ", "<|endoftext|>x<|startoftext|> <|ENDOFTEXT|>", "é é ΑΣ İI ﬁ 漢字かな 🙂🙂 ​",
    "a" * 3000 + " " + "!?" * 500, "x\x1cy\x85z\xa0w v", "same", "same", "word " * 20_000,
]


def test_like_the_library(spark, tmp_path):
    out = rows(bpe.op6_bpe(spark, saved(clashing(documents(spark, TEXTS)), tmp_path)))
    assert out == sorted(((i, *expected(t)) for i, t in enumerate(TEXTS)), key=repr)


def test_like_the_library_on_the_corpus(spark, sf):
    from helpers import texts_of

    assert rows(bpe.op6_bpe(spark, sf)) == sorted(((i, *expected(t)) for i, t in texts_of(sf).items()), key=repr)


def test_empty_table(spark, tmp_path):
    assert rows(bpe.op6_bpe(spark, saved(documents(spark, []), tmp_path))) == []


def test_lexicon_is_a_map_with_shared_ends():
    rng = random.Random(3)
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) + rng.choice(["ing", "tion", ""]) for _ in range(3000)}
    entries = {w.encode(): [rng.randrange(1000) for _ in range(rng.randint(1, 4))] for w in words}
    lexicon = bpe.Lexicon(bpe.Lexicon.compiled(entries))
    others = [b"", b"zzz", b"ingx", b"a" * 50]
    numbers = lexicon.numbers([*entries, *others]).tolist()
    assert [lexicon.ids_of(n) for n in numbers[: len(entries)]] == list(entries.values())
    assert numbers[len(entries) :] == [lexicon.numbers([o]).tolist()[0] for o in others]
    assert all(n == -1 for o, n in zip(others, numbers[len(entries) :], strict=True) if o not in entries)
    prefixes = {w[:i] for w in entries for i in range(len(w) + 1)}
    assert len(lexicon.final) < len(prefixes) / 2  # a trie has a state for each prefix
    assert bpe.Lexicon(bpe.Lexicon.compiled({})).numbers([b"a", b""]).tolist() == [-1, -1]


def test_summary_keeps_what_is_frequent():
    counts = bpe.Counter({f"w{i}": 1 for i in range(100)} | {"the": 50, "of": 40})
    bpe.summary_cut(counts, 10)
    assert set(counts) == {"the", "of"}


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_any_text(text):
    own = bpe.vocabulary(PATH)
    encoder = bpe.Encoder(own, bpe.Lexicon(bpe.Lexicon.compiled({b"the": own.merge(b"the")})))
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    found = encoder.encode([text])[0]
    assert " ".join(e[0] for e in found if e[2]) == " ".join(map(str, ids))
    assert bpe.decode(own, ids) == LIBRARY.decode(ids, skip_special_tokens=False)


def test_kept_words_are_small():
    """A worker keeps what it met: a word that is one piece takes its own text, its ids and two places, no more."""
    own = bpe.vocabulary(PATH)
    encoder = bpe.Encoder(own, bpe.Lexicon(bpe.Lexicon.compiled({})))
    encoder.encode(["warm up"])
    letters = [chr(97 + i) for i in range(26)]
    words = [a + b + c + d + "qzj" for a in letters[:8] for b in letters for c in letters for d in "aeio"]
    text = " ".join(words)
    tracemalloc.start()
    encoder.encode([text])
    gc.collect()
    kept = tracemalloc.get_traced_memory()[0] / len(words)
    tracemalloc.stop()
    assert len(encoder.chunk) > len(words) and kept < 200
