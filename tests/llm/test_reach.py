"""Cases beyond what a bounded look around a place would see."""

import pytest

from folioflow.llm import sentence_units as SU, split_texts as ST, token_sizes as TS
from folioflow.llm.bpe_encode import TOKENIZERS_DIR, read_ranks

from .conftest import needs_tokenizers


def test_rules_see_the_whole_text():
    gap = " " * 60
    assert SU.boundaries(f"It works.{gap}Then it stops.") == [9 + len(gap)]
    assert SU.boundaries(f"It is shown in vol.{gap}12 of it.") == []
    quoted = "“" + "It holds. " * 400 + "”"
    assert SU.boundaries(f"He wrote {quoted} and left.") == []


def test_a_pair_ends_with_its_paragraph():
    assert SU.units('An "open quote. Here.\n\nNext one" ends. Good.') == ['An "open quote.', "Here.", 'Next one" ends.', "Good."]


@pytest.mark.parametrize("text, n", [
    ("Il sig. Rossi non è nel gruppo. Poi lo dice.", 2), ("De dhr. Jansen zijn het model voor ons. Dat is niet zo.", 2), ("ሰላም ነው። ሁለተኛ። ሦስት", 3), ("Առաջինը կա։ Երկրորդը չկա։", 2), ("စာတစ်။ စာနှစ်။", 2), ("ភាសា។ អក្សរ។", 2),
])
def test_languages_and_scripts_of_their_own(text, n):
    assert len(SU.units(text)) == n


def test_last_place_equals_the_full_list():
    text = " ".join(f"“Is it real {i}? Hardly.” Dr. K. Velm asked {i} times, e.g. in vol. {i}. " + "It holds! (So it does.)" for i in range(60))
    every = SU.boundaries(text)
    for high in range(0, len(text), 37):
        want = [b for b in every if b <= high]
        assert SU.Places(text).last(0, high) == (want[-1] if want else None)


@needs_tokenizers
def test_sentence_ends_are_found_however_far_back():
    enc = TS.rank_encoding("byte_bpe_50k", {"byte_bpe_50k": read_ranks(f"{TOKENIZERS_DIR}/byte_bpe_50k.tiktoken")})
    import numpy as np

    widths = np.array([len(enc.decode_single_token_bytes(i)) for i in range(enc.n_vocab)], np.int64)
    head = "It works. " * 400
    text = head + "so " + "word " * 3000 + "end. Then more."
    pieces = ST.split_text(text, 4000, 0, enc, widths)
    assert pieces[0][1] == len(head) - len("It works. ") or pieces[0][1] == len(head)
    assert "".join(text[a:b] for a, b, _ in pieces) == text
