import random

from textforge.functions import lcs


def test_only_lines_that_can_add_a_word_are_compared(monkeypatch):
    compared = []
    one = lcs.lcs_indices
    monkeypatch.setattr(lcs, "lcs_indices", lambda *given: compared.append(given) or one(*given))
    # Every line shares "the" with every other one, and nothing else.
    make = lambda side: [[f"{side}{k}", "the", f"{side}{k + 1}"] for k in range(0, 100, 2)]
    assert lcs.union_hits(make("r"), make("p")) == 50 and not compared
    # Equal lines are compared once, whichever side repeats them.
    assert lcs.union_hits([["a", "b", "c"]] * 30, [["c", "a", "b"]] * 20 + [["x"]]) == 40 and len(compared) == 1


def test_union_equals_that_of_all_pairs():
    generator = random.Random(7)
    for _ in range(300):
        words = [f"w{k}" for k in range(generator.randrange(2, 20))]
        make = lambda: [generator.choices(words, k=generator.randrange(9)) for _ in range(generator.randrange(7))]  # noqa: B023, E731
        reference, candidate = make(), make()
        left, hits = {}, 0
        for word in (w for line in candidate for w in line):
            left[word] = left.get(word, 0) + 1
        for line in reference:
            for index in sorted({k for other in candidate for k in lcs.lcs_indices(line, other)}):
                if left.get(line[index], 0) > 0:
                    hits, left[line[index]] = hits + 1, left[line[index]] - 1
        assert lcs.union_hits(reference, candidate) == hits
