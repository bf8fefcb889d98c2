"""The search for leaked passages loses nothing that its rule accepts, whatever the slips and whatever other items there are."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from skyloom.llm import leaks

STEMS = "copper lantern bailiff harvest ledger sundial compass widow regatta kettle anchor verdict almanac pilot ferry glazier the of and in at to it was for".split()


def item(rng, n=40):
    return [rng.choice(STEMS) + (str(rng.randint(1, 60)) if rng.random() < 0.3 else "") for _ in range(n)]


def swapped(word):
    return word[0] + word[2] + word[1] + word[3:] if len(word) > 3 and not word.isdigit() else word


def accepts(item, text):
    """The rule by its words: a passage of twelve words against every stretch of the text, no bands and no q-grams."""
    for i in range(len(item) - leaks.WORDS + 1):
        part = item[i : i + leaks.WORDS]
        for j in range(len(text)):
            if not leaks.alike(part[0], text[j]):
                continue
            for n in range(leaks.WORDS - leaks.BUDGET, leaks.WORDS + leaks.BUDGET + 1):
                other = text[j : j + n]
                if len(other) < n or not leaks.alike(part[-1], other[-1]):
                    continue
                row = list(range(n + 1))
                for a, x in enumerate(part, 1):
                    new = [a]
                    for b, y in enumerate(other, 1):
                        new.append(min(row[b] + 1, new[-1] + 1, row[b - 1] + (not leaks.alike(x, y))))
                    row = new
                if row[n] <= leaks.BUDGET:
                    return True
    return False


def quoted(rng, source, misspelled, altered):
    at = rng.randrange(0, len(source) - 12)
    quote = list(source[at : at + 12])
    for k in rng.sample(range(12), misspelled):
        quote[k] = swapped(quote[k])
    for _ in range(altered):
        k, how = rng.randrange(1, len(quote) - 1), rng.randrange(3)
        quote[k : k + 1] = [["violin"], [], [quote[k], "indeed"]][how]
    return item(rng, rng.randint(0, 25)) + quote + item(rng, rng.randint(0, 25))


OTHERS = [" ".join(item(random.Random(1000 + k))) for k in range(1200)]


def big(source):
    texts = [" ".join(source), *OTHERS[1:]]
    return leaks.Items(list(range(len(texts))), texts, [set()] * len(texts))


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**9), st.integers(0, 12), st.integers(0, 3))
def test_whatever_the_rule_accepts_is_found(seed, misspelled, altered):
    rng = random.Random(seed)
    source = item(rng)
    text = quoted(rng, source, misspelled, altered)
    alone = leaks.Items([0], [" ".join(source)], [set()])
    assert ((0, 0) in alone.search([text])) == accepts(source, text)


def test_other_items_of_the_block_change_nothing():
    rng = random.Random(11)
    source = item(rng)
    texts = [quoted(rng, source, m, a) for m in range(9) for a in range(4) for _ in range(3)]
    alone = leaks.Items([0], [" ".join(source)], [set()])
    want = {k for _, k in alone.search(texts)}
    assert want == {k for k, t in enumerate(texts) if accepts(source, t)}
    assert {k for i, k in big(source).search(texts) if i == 0} == want
    # slips of spelling alone never hide a passage
    plain = [quoted(rng, source, m, 0) for m in range(9) for _ in range(10)]
    assert len({k for i, k in big(source).search(plain) if i == 0}) == len(plain)


def test_spellings_against_all_pairs():
    rng = random.Random(3)
    vocabulary = sorted({*STEMS, *(x for s in STEMS for x in (swapped(s), s + s, s[:-1], s[1:] + "x", s * 3))})
    spell = leaks.Spellings(vocabulary)
    seen = [*vocabulary, "", "a", "12", "1234", *("".join(rng.choice("abcdetrs") for _ in range(rng.randint(1, 14))) for _ in range(300))]
    for w in seen:
        assert sorted(spell.of(w)) == [k for k, v in enumerate(vocabulary) if leaks.alike(w, v)], w


def test_shared_wording_counts_for_none(spark):
    rng = random.Random(5)
    common = item(rng, 20)
    texts = [" ".join(item(rng, 15) + common + item(rng, 15)) for _ in range(3)]
    ii = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(7, texts[0])], "item_id long, text string")
    dd = spark.createDataFrame([(10, " ".join(common)), (11, texts[1].title()), (12, " ".join(texts[0].split()[:14]))], "doc_id long, text string")
    got = {(r.item_id, r.doc_id) for r in leaks.found(ii, dd).collect()}
    assert got == {(1, 11), (0, 12), (7, 12)}  # equal items don't share wording with each other


def test_words_of_texts():
    assert leaks.words("Ｆｕｌｌ ﬁne café café <b>b​old</b> &amp; Неllo [...] x2") == ["full", "fine", "cafe", "cafe", "bold", "hello", "x2"]
