import pytest

from tallyforge.llm import residue as R

COLS = "doc_id long, text string, url string, matter_type string, file_no string, source string"

CASES = [
    "The clerk approved {{ vendor }} the invoice.", "because ${fund} rose", "<%= payee %>", "before {% day %} noon", "[[sponsor]]", "the <<fund>> panel", "%file_no% adopted", "__passed_date__ adopted", "@@payee@@", "#{matter_title}",
    "To be completed: {agency} / {amount}", "(YOUR vendor GOES HERE)", "Title: <TITLE>", "RESOLUTION NO. [NUMBER]", "The clerk read «hearing_date» and «Contract Term» aloud.", "Dear [First Name], hello", "[enter agency name]", "[summary pending] [summary pending]",
    "Lorem ipsum dolor sit amet.", "asdf asdf asdf asdf asdf", "xxxxx xxxx xxxxxxx xx. more", "Your text here. Your text here.", "Replace this paragraph with your own summary.", "Test matter please ignore.", "abc def ghi abc def ghi",
    "HTTP Error 504 - Gateway Timeout.", "Approved.\n404 Not Found", "Error al cargar la página (403).", "Access denied. Contact us.", "Traceback (most recent call last):", "java.lang.NullPointerException\n\tat a.Main.run(Main.java:33)", "Your session has expired.", "Oops! Something went wrong on our side.",
    "Please enable JavaScript to view this page.", "<noscript>You need to enable JavaScript</noscript>", "Su navegador no admite JavaScript. Actívelo para ver", "This docket viewer requires scripts.",
]
REAL = [
    "Residents complained that the payment portal kept returning 404 Not Found pages during May.", "The contract covers JavaScript training for 82 patrons who enable their own devices.", "Staff found lorem ipsum text on an old brochure and had it reprinted.", "A placeholder line of $5 stays in the capital plan.",
    "An access denied notice was mailed to Acme LLC over unpaid permits.", "The help desk closed 60 tickets about expired sessions and internal server errors.", "Subsections {a} and {b} of the fee table are repealed [amended May 2011].", 'The motion read "no funds [sic] shall lapse".', "The template [Exhibit C] was adopted.",
    '<|endoftext|> was typed in the notes field', 'Insert the word "annual" after "the" in section 17.', "Two members recused themselves. Two members recused themselves.", "50% of 20% a<br/>b",
]


SUBJECTS = ("Residents", "The help desk", "The library staff", "Members that found the contract", "The payment office", "The clerk", "The capital panel", "The annual audit team", "The patrons", "The portal crew", "Two old councils", "The server desk")
ACTS = ("approved the payment for May", "closed 40 tickets about permits", "read the motion on funds and devices", "kept the notice about section 17 in the plan", "complained about subsections of the fee table", "adopted the template and the brochure", "mailed the letters over unpaid lines", "enable training during March", "recused themselves from the bids")
ENDS = ("without change.", "after the hearing.", "under file 12.", "and had it reprinted.", "until bids open.", "but did not amend internal pages.", "who own no returning expired permit.")


def corpus(n=400):
    """Ordinary texts of the same host."""
    return [" ".join(f"{SUBJECTS[(k + j) % 12]} {ACTS[(k // 3 + 2 * j) % 9]} {ENDS[(k * 5 + j) % 7]}" for j in range(3)) for k in range(n)]


def docs(spark, texts, background=True):
    every = [*texts, *(corpus() if background else [])]
    return spark.createDataFrame([(k, t, f"https://r.example/matter/{k}", "Ordinance", f"O-{k}", f"s{k % 3}") for k, t in enumerate(every)], COLS)


def found(spark, texts, **options):
    return {r[0] for r in R.residue(docs(spark, texts), **options).collect()}


def test_cases_and_real_sentences(spark):
    own = corpus(2)
    real = [f"{own[0]} {t} {own[1]}" for t in REAL]
    got = found(spark, CASES + real)
    missed = [CASES[k] for k in range(len(CASES)) if k not in got]
    wrong = [(CASES + real + corpus())[k] for k in sorted(got) if k >= len(CASES)]
    assert (missed, wrong) == ([], [])


def test_a_notice_inside_real_content_is_a_case(spark):
    own = corpus(3)
    got = found(spark, [f"{own[0]} Please enable JavaScript to view this page. {own[1]}", f"{own[1]}\nBody copy to follow.", f"{own[2]} blah blah blah blah blah blah", own[0]])
    assert got == {0, 1, 2}


def test_mismatch_with_the_corpus_decides(spark):
    """Without the comparison of terms, sentences that speak of errors are cases too."""
    told = [corpus(1)[0] + " Residents complained that the payment portal kept returning 404 Not Found pages during May."]
    assert found(spark, told) == set()
    assert 0 in found(spark, told, mismatch=1.0)


def test_found_without_phrases(spark):
    """Mismatch, low information, repetition, notice words and host evidence find bodies of which no phrase is known."""
    pages = [f"Sorry, the browser of visitor {k} timed out. Retry shortly." for k in range(5)] + [f"Wartungsfenster. Bitte Knoten {k} neu laden." for k in range(6)] + ["Zorp fleem. Zorp fleem. Zorp fleem.", "Ein Satz, den niemand sonst schrieb."]
    d = docs(spark, pages)
    e = {r["doc_id"]: r for r in R.evidence(d, phrases=False).collect()}
    assert {k for k, r in e.items() if r["hit"]} == {*range(12)}
    assert all(e[k]["whole"] and e[k]["pages"] == (5 if k < 5 else 6) and e[k]["sources"] == 3 and e[k]["hosts"] == 1 for k in range(11))
    assert e[12]["whole"] and not e[12]["hit"]  # one body of another language, told once, is no notice


@pytest.mark.parametrize("text", [None, "", "  \n "])
def test_no_text_is_no_case(spark, text):
    assert R.residue(docs(spark, [text])).count() == 0
    assert R.residue(docs(spark, [text], background=False)).count() == 0


def test_repeats_long_texts_empty_tables_and_clashing_columns(spark):
    long = "A real sentence about drains. " * 20000
    d = docs(spark, [long + "{{ fund }}", "The clerk approved the payment for May."]).selectExpr("*", "text AS hit", "url AS kind", "url AS pages")
    d = d.unionAll(d)
    assert [r[0] for r in R.residue(d).collect()] == [0]
    assert R.residue(d.where("false")).count() == 0
    assert d.count() - R.clean(d).count() == 2


def test_slots_that_end_in_here_and_bare_field_names(spark):
    cases = ["Adopted on [passed date HERE] by the panel.", "See [file no HERE] for costs.", "The [matter title HERE] was heard.", "[FISCAL YEAR HERE]", "[file no. here]", "{clerk signature here} signed", "<hearing_date_HERE>", "[one two three four HERE]"]
    cases += [f"The [{w}] was named." for w in ("payee", "vendor", "agency", "clerk", "Council", "matter", "contract", "hearing", "file", "member", "sponsor", "district", "amount")]
    real = ["The motion stands [sic] as [amended May 2011].", "[a b c d e here]", "It was filed (copy kept here) and [Exhibit C] was read.", "[here]", "The [first] reading and the [last] one.", "Maps [see there] were shown."]
    got = found(spark, cases + real)
    assert [c for k, c in enumerate(cases) if k not in got] == []
    assert [(real + corpus())[k - len(cases)] for k in sorted(got) if k >= len(cases)] == []
