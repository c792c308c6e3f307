import random

import pyarrow as pa
import pytest

from docquery.llm import tokens


class Counted(tokens.TextEncoder):
    """Counts the bytes that the tokenizer is given."""

    given = 0

    def _calls(self, texts):
        self.given += sum(len(t.encode()) for t in texts)
        return super()._calls(texts)


def ids_of(encoder, texts):
    ids, counts = encoder.encode_column(pa.array(texts, pa.string()))
    out, low = [], 0
    for n in counts.tolist():
        out.append(ids[low : low + n].tolist())
        low += n
    return out


def test_a_word_of_an_earlier_batch_is_not_encoded_again():
    encoder = Counted(tokens.default_path())
    texts = [" ".join(f"w{i * j % 97}x" for j in range(60)) for i in range(1, 40)]
    first = ids_of(encoder, texts)
    before = encoder.given
    assert before and ids_of(encoder, texts) == first and encoder.given == before
    assert ids_of(encoder, [texts[3] + " unseen"]) == [encoder.whole(texts[3] + " unseen").tolist()]
    assert 0 < encoder.given - before - len(texts[3] + " unseen") <= len(" unseen")  # whole() had it all, the column one word


@pytest.mark.parametrize("known", [0, 1, 7, 50, 1 << 19])
def test_ids_are_the_tokenizers_whatever_is_kept(known):
    rng = random.Random(known)
    parts = ["a", "don't", "Ünïcödé", "12,5", "<|endoftext|>", "x\n", "\n", "", " ", "　", "été.", "z" * 60, "日本語", "...", "\t", "é"]
    encoder = tokens.TextEncoder(tokens.default_path(), group=200, known=known)
    for _ in range(40):
        texts = [None if not rng.randrange(9) else " ".join(rng.choice(parts) + (str(rng.randrange(30)) if rng.randrange(2) else "") for _ in range(rng.randrange(25))) for _ in range(8)]
        assert ids_of(encoder, texts) == [[] if t is None else encoder.whole(t).tolist() for t in texts]
        assert len(encoder.words) == len(encoder.counts) == len(encoder.met) <= known and encoder.counts.sum() == len(encoder.ids)
        assert all(len(w) <= tokens.KNOWN_BYTES for w in encoder.words.to_pylist())


def test_words_met_again_outlast_those_that_were_not():
    encoder = Counted(tokens.default_path(), known=40)
    often = "".join(f" often{i}" for i in range(10))
    for n in range(12):
        ids_of(encoder, ["a" + often + "".join(f" once{n}n{i}" for i in range(20))])
    assert {f" often{i}".encode() for i in range(10)} <= set(encoder.words.to_pylist())
