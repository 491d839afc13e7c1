"""Recall of line deduplication on prose, URLs, code, writing without blanks, and lines that share most of their text."""

import random
import string

import pytest

from tests.llm.test_line_bands import jaccard, removed

LETTERS = string.ascii_lowercase


def word(rng, low=3, high=9):
    return "".join(rng.choice(LETTERS) for _ in range(rng.randrange(low, high)))


def prose(rng):
    return " ".join(word(rng) for _ in range(rng.randrange(12, 60)))


def url(rng):
    return "https://www." + word(rng, 6, 12) + ".com/" + "/".join("".join(rng.choice(LETTERS + string.digits) for _ in range(rng.randrange(6, 16))) for _ in range(rng.randrange(4, 9)))


def code(rng):
    names = [word(rng, 2, 8) for _ in range(4)]
    return "for(var " + names[0] + "=0;" + ";".join(f"{rng.choice(names)}.{word(rng, 3, 7)}({rng.choice(names)}[{rng.randrange(999)}],{word(rng, 2, 5)})" for _ in range(rng.randrange(4, 9))) + ";)"


def ideographs(rng):
    return "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(rng.randrange(60, 200)))


COMMON = " ".join(word(random.Random(99)) for _ in range(24))


def boilerplate(rng):
    return COMMON + " " + " ".join(word(rng) for _ in range(14))


def edited(rng, line):
    """A near copy: one place is changed."""
    at = rng.randrange(len(line) - 6)
    return line[:at] + "".join(rng.choice(LETTERS) if c.isascii() else chr(rng.randrange(0x4E00, 0x9000)) for c in line[at : at + 4]) + line[at + 4 :]


@pytest.mark.parametrize(("kind", "pairs"), [(prose, 300), (url, 300), (code, 300), (ideographs, 300), (boilerplate, 1500)])
def test_near_copies_are_found(spark, tmp_path, kind, pairs):
    rng = random.Random(17)
    firsts, copies = [], []
    while len(copies) < pairs:
        line = kind(rng)
        near = edited(rng, line)
        if line != near and jaccard(line, near) >= 0.8:
            firsts.append(line)
            copies.append(near)
    got = removed(spark, tmp_path, firsts + copies)
    assert not [k for k in got if k < pairs]
    assert len(got) >= 0.98 * pairs


def test_long_lines_that_repeat_few_shingles(spark, tmp_path):
    rng = random.Random(18)
    lines = [(word(rng) + " " + word(rng) + " ") * rng.randrange(150, 400) for _ in range(40)]
    copies = [line + line[: rng.randrange(5, 30)] + "x" for line in lines]
    got = removed(spark, tmp_path, lines + copies)
    want = [k for k in range(40) if jaccard(lines[k].strip(), copies[k]) >= 0.8]
    assert len([k for k in got if k >= 40]) >= 0.98 * len(want) and len(want) > 10
