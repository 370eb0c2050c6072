import re
from collections import Counter

import zstandard

from tidemark.llm import quality_rules as Q


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = {w for w, n in Counter(windows).items() if n > 1}
    repeated = len({j for i, w in enumerate(windows) if w in many for j in (i, i + 1, i + 2)})
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), repeated


def brute_kept(text):
    """The whole verdict, written out: base rules, then the ratio of the text and of its chunks, and symbols of chunks."""
    base = brute(text)
    if base[0] < 50 or 100 * base[4] > 50 * base[0]:
        return False
    data = text.encode()

    def sound(part):
        k, wide = 1024 / len(part), sum(b > 127 for b in part) / len(part)
        ratio = len(zstandard.compress(part, Q.LEVEL)) / len(part)
        return Q.FLOOR * k**Q.FALL * (1 - Q.SEVERAL * wide) <= ratio <= (Q.TOP + Q.MORE * k**Q.SINK) * (1 + Q.RAISE * wide)

    chunks = [data[i : i + 1024] for i in range(0, len(data), 1024)]
    if len(data) > 1024:
        chunks[-1] = data[-1024:]  # the last one overlaps the one before
    symbols = lambda c: sum(b in b"#*$%&|<>" for b in c) / max(1, sum(b not in b"\x20\x09\x0a\x0b\x0c\x0d" for b in c))
    bad = sum(symbols(c) > Q.MOST_SYMBOLS or not sound(c) for c in chunks)
    return sound(data) and bad <= Q.BAD_CHUNKS * len(chunks)


def test_verdict_matches_brute_force(spark, documents, texts):
    rows = Q.quality_report(documents).collect()
    assert all(r.kept == brute_kept(texts[r.doc_id]) for r in rows) and {r.kept for r in rows} == {True, False}


def test_base_matches_brute_force(documents, texts):
    for r in Q.quality_report(documents).collect():
        base = brute(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base
        assert r.base_failed == (base[0] < 50 or 100 * base[4] > 50 * base[0])
        assert not (r.base_failed and r.kept)


def test_other_spaces_are_no_spaces():
    assert Q.base_counts("a\xa0b\x1cc d\x85e")[0] == 2 and Q.base_counts("é\n") == (1, 1, 0, 0, 0)


def test_bands():
    packer = zstandard.ZstdCompressor(level=Q.LEVEL)
    import random

    rng = random.Random(1)
    prose = " ".join("".join(rng.choices("etaoinshrdlu", weights=range(12, 0, -1), k=rng.randint(2, 9))) for _ in range(900))
    noise = "".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", k=6000))
    assert Q.compression(prose, packer)[4]
    assert not Q.compression(noise, packer)[4] and not Q.compression("the same again " * 400, packer)[4]
    assert Q.compression("short", packer)[4] and Q.compression(None, packer) == (0, None, 0, 0, True)
    assert not Q.compression(prose + "ab " * 3000, packer)[4]  # a bad stretch of chunks


def test_odd_rows(odd, empty):
    got = {r.doc_id: r for r in Q.quality_report(odd).collect()}
    assert got[2].n_words == 0 and got[2].base_failed and got[5].n_words == 60_000 and not got[5].kept and 2**60 + 1 in got
    assert Q.quality_filter(odd).columns == odd.columns and Q.quality_filter(empty).count() == 0 and Q.quality_report(empty).count() == 0


def test_clean_long_texts_are_kept(spark):
    """Different texts labelled good, joined to 0.5 and 5 MB, and reference prose."""
    from pydoc_data import topics

    from tidemark.llm.shared import table

    packer = zstandard.ZstdCompressor(level=Q.LEVEL)
    data = "/root/testdata/sf0.1"
    good = table(spark, data, "documents").join(table(spark, data, "labels").where("quality = 1"), "doc_id")
    rows = [(r.lang, r.text) for r in good.select("lang", "text").collect() if r.text and 2 * Q.base_counts(r.text)[4] <= len(r.text.split())]
    for lang, least in (("de", 500_000), ("fr", 500_000), (None, 5_000_000)):
        joined = "\n".join(dict.fromkeys(t for k, t in rows if lang in (None, k)))[:least]
        assert len(joined) == least and Q.compression(joined, packer)[4], lang
    prose = "\n".join(topics.topics.values())
    assert all(Q.compression(prose[:n], packer)[4] for n in (8_000, 20_000, 400_000))


RUSSIAN = """Утром дождь прекратился, и над рекой медленно поднялся туман. Старый паромщик вышел на берег, проверил верёвки и долго смотрел на другую сторону, где уже собирались люди с корзинами и мешками. Он работал здесь почти сорок лет и знал каждого в обеих деревнях, их детей, собак и даже лошадей. Весной вода поднималась так высоко, что приходилось ждать по нескольку дней, зато летом мальчишки переходили реку вброд и смеялись над его медленной лодкой. В этот день первой пришла учительница с двумя связками книг для новой школы. Она рассказала, что мост всё-таки построят к осени, инженеры уже приезжали и мерили глубину. Паромщик только кивнул: о мосте говорили ещё при его отце, и каждый раз чего-нибудь не хватало — то брёвен, то денег, то согласия соседей. Когда лодка отошла от берега, солнце пробилось сквозь облака, и рыба начала плескаться у самых камышей. На середине реки учительница спросила, чем он займётся, если мост действительно появится. Он задумался, опустил весло и ответил, что тогда наконец починит крышу и научится читать."""
HINDI = """सुबह होते ही बारिश थम गई और नदी के ऊपर धीरे-धीरे कोहरा उठने लगा। बूढ़ा मल्लाह किनारे पर आया, उसने रस्सियाँ जाँचीं और देर तक दूसरी ओर देखता रहा, जहाँ लोग टोकरियाँ और बोरे लेकर इकट्ठा हो रहे थे। वह यहाँ लगभग चालीस साल से काम कर रहा था और दोनों गाँवों के हर आदमी को, उनके बच्चों और जानवरों तक को पहचानता था। बरसात में पानी इतना चढ़ जाता कि कई दिन रुकना पड़ता, लेकिन गर्मियों में लड़के पैदल ही नदी पार कर लेते और उसकी धीमी नाव पर हँसते। उस दिन सबसे पहले अध्यापिका आई, जिसके पास नए विद्यालय के लिए पुस्तकों के दो बंडल थे।"""


def test_clean_texts_of_other_scripts_are_kept():
    packer = zstandard.ZstdCompressor(level=Q.LEVEL)
    assert Q.compression(RUSSIAN, packer)[4] and Q.compression(HINDI, packer)[4]


def test_repetition_is_still_rejected():
    packer = zstandard.ZstdCompressor(level=Q.LEVEL)
    loop = "".join(f"Item {i} of the list costs {i * 7} crowns and can be had in shop {i % 9} today.\n" for i in range(9000))
    assert not any(Q.compression(loop[:n], packer)[4] for n in (1200, 5000, 50_000, 500_000))
    assert not Q.compression(RUSSIAN * 40, packer)[4]


def test_labelled_junk_is_caught(spark):
    """Of the rows that pass the base, good ones stay and bad ones go, short ones among them."""
    from tidemark.llm.shared import table

    data = "/root/testdata/sf0.1"
    got = Q.quality_report(table(spark, data, "documents")).join(table(spark, data, "labels"), "doc_id").where("not base_failed").select("quality", "kept", "n_bytes").collect()
    for short in (False, True):
        rows = [r for r in got if not short or r.n_bytes < 800]
        bad, good = [r.kept for r in rows if r.quality == 0], [r.kept for r in rows if r.quality == 1]
        assert sum(bad) <= 0.02 * len(bad) and sum(good) >= 0.99 * len(good), short


def test_short_random_text_is_rejected():
    import random

    packer, rng = zstandard.ZstdCompressor(level=Q.LEVEL), random.Random(7)
    noise = "".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", k=1000))
    assert not any(Q.compression(noise[:n], packer)[4] for n in (300, 400, 500, 700, 800, 1000))


def test_last_chunk_is_judged():
    packer = zstandard.ZstdCompressor(level=Q.LEVEL)
    words = RUSSIAN.split()
    assert Q.compression(RUSSIAN, packer)[2:4] == (2, 0)
    assert Q.compression(" ".join(words) + " ---" * 190, packer)[2:4] == (3, 1)
