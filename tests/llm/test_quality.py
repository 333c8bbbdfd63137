from __future__ import annotations

import base64
import random

import pytest

from moraine.llm.quality import STATS, describe, text_statistics

NAMES = [n for n, _ in STATS]
PROSE = {
    "en": "The old man walked along the river because he had lost his way in the dark. Nobody saw him before the morning came, and then it was too late.",
    "de": "Der alte Mann ging am Fluss entlang, weil er sich in der Nacht verlaufen hatte. Niemand sah ihn, bevor der Morgen kam, und dann war es zu spät.",
    "it": "Il vecchio camminava lungo il fiume perché non trovava più la strada di casa. Nessuno lo ha visto prima della mattina, e poi era troppo tardi.",
    "fr": "Le vieil homme marchait le long de la rivière, car il ne trouvait plus la route de la maison. Personne ne l’a vu avant le matin, et puis il était trop tard.",
}
RNG = random.Random(1)
NAMES_LIST = ["Anna Berg", "Karl Otto", "Mira Sol", "Ivo Tamm", "Lena Hart", "Piet Moor", "Nils Roth", "Ada Quist"]


def scrambled(text):
    return " ".join("".join(RNG.sample(w, len(w))) for w in text.split())


JUNK = {
    "table": "| Name | Year |\n|---|---|\n" + "\n".join(f"| {n} | {1900 + i} |" for i, n in enumerate(NAMES_LIST)),
    "list": "\n".join(f"{i}. {n} (19{i}0)" for i, n in enumerate(NAMES_LIST)),
    "bullets": "\n".join(f"* {n}" for n in NAMES_LIST),
    "semicolons": "; ".join(NAMES_LIST * 2),
    "numbers": "\n".join(" ".join(f"{RNG.random() * 900:8.2f}" for _ in range(6)) for _ in range(8)),
    "json": "\n".join('{"id":%d,"score":%.3f,"title":"%s"}' % (i, i / 7, n) for i, n in enumerate(NAMES_LIST)),
    "log": "\n".join(f"2024-01-{i:02d} 10:00:{i:02d} INFO worker-{i} handled request {i * 77} in {i} ms" for i in range(1, 15)),
    "base64": base64.b64encode(bytes(RNG.randrange(256) for _ in range(400))).decode(),
    "spam": "click " * 40,
    "spaced": " ".join(PROSE["en"]).replace("  ", " "),
    "scrambled": scrambled(PROSE["en"] + " " + PROSE["en"]),
    "menu": " | ".join(["Home", "Log in", "Help", "Next »"] * 6),
    "symbols": "★★★ ▒▒▒ ■■ →→→ ★★" * 6,
}


def stat(text):
    return dict(zip(NAMES, describe(text), strict=True))


@pytest.mark.parametrize("lang", PROSE)
@pytest.mark.parametrize("change", [str, str.upper, str.lower, lambda t: t.replace(".", "").replace(",", ""), lambda t: "\n".join(t[i : i + 45] for i in range(0, len(t), 45)), lambda t: t.replace(" ", " "), lambda t: t[: t.index(".") + 1]])
def test_prose_in_any_dress(lang, change):
    assert stat(change(PROSE[lang]))["is_prose"] is True


@pytest.mark.parametrize("kind", JUNK)
def test_other_texts(kind):
    assert stat(JUNK[kind])["is_prose"] is False


@pytest.mark.parametrize("kind", ["table", "json", "base64", "numbers"])
def test_majority_decides(kind):
    assert stat(PROSE["en"] * 12 + "\n" + JUNK[kind])["is_prose"] is True
    assert stat("The old man walked along the river.\n" + "\n".join([JUNK[kind]] * 4))["is_prose"] is False


def test_repeats_and_counts():
    s = stat("one line here\none line here\nanother line\n\nlast part, at the end.")
    assert (s["n_words"], s["n_lines"]) == (13, 4) and s["duplicate_line_share"] == pytest.approx(13 / 60, abs=0.05) and s["end_mark_share"] == 0.25
    assert stat("spam ham " * 50)["top_ngram_coverage"] > 0.9


def test_table_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, PROSE["en"] * 500), (5, JUNK["list"]), (5, JUNK["list"]), (None, "x")]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, prose_share double")
    got = text_statistics(df, "doc_id", "text").collect()
    assert len(got) == 7
    by = {r["doc_id"]: r for r in got}
    assert [by[i]["is_prose"] for i in (1, 2, 3, 4, 5)] == [None, None, None, True, False] and by[1]["kind"] == "empty"
    assert text_statistics(df.limit(0), "doc_id", "text").count() == 0


BOILERPLATE = {
    "menu": "Print | Talk | Log in | History | Log in | Help | Random page | Log in | Top | Next » | Log in | Menu",
    "bars": "Menu | Log in | Log in | « Previous | History | Random page | Print | Log in | Print | Top | Log in | Help",
    "path": "Home » The shop » In stock » All of it » For the home » On sale » About us",
    "dots": "About us · Log in · Terms of use · By the way · For you · In the news",
    "dashes": "Home - Log in - For you - About us - Help - The shop - The news",
    "footer": "All of the rights to this site are with the owner\nPlease log in to see more of the page\n" * 6,
    "paragraphs": "\n\n".join([PROSE["en"][:60] + "\n" + PROSE["en"][60:]] * 4),
    "run on": " ".join(["more of this in the shop and on the page that you have seen before with us"] * 8),
}


@pytest.mark.parametrize("kind", BOILERPLATE)
def test_boilerplate(kind):
    got = stat(BOILERPLATE[kind])
    assert got["is_prose"] is False and got["kind"] == "boilerplate"


def test_bulleted_items_are_a_list():
    items = "\n".join(f"- {x}" for x in ("Terms of use", "About the site", "Log in to the forum", "The news of the day"))
    assert (stat(items)["is_prose"], stat(items)["kind"]) == (False, "list")
    assert stat("\n".join(f"– {PROSE[k]}" for k in ("en", "de")))["is_prose"] is True
    assert stat(PROSE["en"] + "\n" + BOILERPLATE["menu"][:60])["is_prose"] is True
    assert stat("The old man walked along the river.\n" + BOILERPLATE["menu"])["is_prose"] is False


def test_marks_inside_prose():
    assert stat("« Il est là » dit la mère, et puis » elle a ri » avec les autres » dans la maison.")["is_prose"] is True
    assert stat("He came - as they said - in the night - and then he left - with nobody who saw him.")["is_prose"] is True
    assert stat("The moon is out / and we are here / with all the rest / of the year")["is_prose"] is True


OTHER = {
    "nl": "De oude man liep langs de rivier omdat hij in het donker de weg kwijt was geraakt. Niemand zag hem voordat de ochtend kwam, en toen was het te laat. Zijn dochter wachtte thuis met een kaars voor het raam.",
    "pl": "Stary człowiek szedł wzdłuż rzeki, ponieważ w ciemności zgubił drogę do domu. Nikt go nie widział, zanim nadszedł ranek, a wtedy było już za późno. Jego córka czekała w oknie ze świecą.",
    "ru": "Старик шёл вдоль реки, потому что в темноте потерял дорогу домой. Никто не видел его до самого утра, а потом было уже слишком поздно. Его дочь ждала у окна со свечой.",
    "zh": "老人沿着河边走，因为他在黑暗中迷了路。直到早晨来临之前，没有人看见他，那时已经太晚了。他的女儿在窗前点着蜡烛等他回家。",
    "es": "El viejo caminaba junto al río porque había perdido el camino en la oscuridad. Nadie lo vio antes de que llegara la mañana, y entonces ya era demasiado tarde.",
}


@pytest.mark.parametrize("lang", OTHER)
def test_prose_in_other_languages(lang):
    assert stat(OTHER[lang])["is_prose"] is True
    if lang in ("nl", "pl", "ru"):
        assert stat("\n".join(w for w in OTHER[lang].title().split()))["is_prose"] is False


def test_five_bullets_a_footer_and_one_sentence_again():
    assert stat("\n".join(f"- {x}" for x in ("the red house", "a small mill", "the old river road", "two boats", "the town hall")))["is_prose"] is False
    footer = "All rights of the owner are reserved\nRead the terms of use\n"
    assert stat(footer * 3)["is_prose"] is False
    assert stat("\n".join([PROSE["en"][:70]] * 8))["is_prose"] is False


def test_a_batch_equals_its_texts():
    texts = [None, "", *PROSE.values(), *JUNK.values(), *OTHER.values(), "x", "one two", "\u200b\n \u2028end."]
    from moraine.llm.quality import describe_all

    assert describe_all(texts) == [describe(t) for t in texts]


def test_ngram_coverage_by_counting():
    from collections import Counter

    rng = random.Random(5)
    for _ in range(30):
        words = [rng.choice(["a", "bb", "ccc", "dd"]) for _ in range(rng.randrange(8, 60))]
        if rng.random() < 0.5:
            words = words + words
        total, top, covered = sum(map(len, words)), 0, set()
        for n in (2, 3, 4):
            grams = Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
            top = max([top, *(c * sum(map(len, g)) for g, c in grams.items() if c > 1)])
        seen = set()
        for i in range(len(words) - 9):
            if tuple(words[i : i + 10]) in seen:
                covered |= set(range(i, i + 10))
            seen.add(tuple(words[i : i + 10]))
        s = stat(" ".join(words))
        assert s["top_ngram_coverage"] == pytest.approx(min(1, top / total)) and s["repeated_ngram_coverage"] == pytest.approx(sum(len(words[i]) for i in covered) / total)
