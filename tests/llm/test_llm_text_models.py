import random

import llm_cases as C
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontam, langid, toxicity
from tidemark.llm.common import id_crc

SF = "/root/testdata/sf0.01"


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("distance,min_fuzzy", [(1, 5), (2, 4), (0, 3)])
def test_automaton_equals_edit_distance(distance, min_fuzzy):
    rnd = random.Random(distance)
    word = lambda n: "".join(rnd.choice("abc") for _ in range(n))
    terms = sorted({word(rnd.randrange(2, 8)) for _ in range(25)})
    machine = toxicity.LexiconAutomaton(terms, distance, min_fuzzy)
    for _ in range(3000):
        token = word(rnd.randrange(0, 9))
        fits = [edit_distance(token, t) for t in terms
                if edit_distance(token, t) <= (distance if len(t) >= min_fuzzy else 0)]
        got = machine.match(token)
        assert (got is None) == (not fits), token
        if got:
            assert got[1] == min(fits) == edit_distance(token, terms[got[0]])


def test_long_terms_take_two_edits_and_stretched_letters_none():
    terms = ["a$$", "idiot", "moron", "pathetic", "stupid"]
    cache = toxicity.TokenMatches(toxicity.LexiconAutomaton(terms, toxicity.DISTANCE, toxicity.MIN_FUZZY, toxicity.LONG))
    hits = lambda s: [(terms[t], e) for t, e, _ in toxicity.text_matches(s, cache)]
    assert hits("you,idiot") == [("idiot", 0)]
    assert hits("stupid/moron") == [("stupid", 0), ("moron", 0)]
    assert hits("scum...moron, _moron_") == [("moron", 0)] * 2
    assert hits("an a$$!") == [("a$$", 0)]
    assert hits("stuuupid") == [("stupid", 0)]
    assert hits("patthetyc") == [("pathetic", 2)]
    assert hits("ass stpd idt mor pattheetyc") == []


def test_automaton_gives_each_term_its_own_number_of_edits():
    rnd = random.Random(9)
    word = lambda n: "".join(rnd.choice("ab") for _ in range(n))
    terms = sorted({word(rnd.randrange(2, 11)) for _ in range(40)})
    machine = toxicity.LexiconAutomaton(terms, 2, 5, 8)
    for _ in range(3000):
        token = word(rnd.randrange(0, 12))
        fits = [edit_distance(token, t) for t in terms if edit_distance(token, t) <= (len(t) >= 5) + (len(t) >= 8)]
        got = machine.match(token)
        assert (got and got[1]) == min(fits, default=None), token


def test_no_text_is_shuffled_while_learning(spark, monkeypatch):
    """With broadcast joins off but for the bounded sample, no exchange carries a text or its words."""
    plans = []
    real = toxicity.save
    monkeypatch.setattr(toxicity, "save", lambda df, name: plans.append((name, df._jdf.queryExecution().executedPlan().toString())) or real(df, name))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs, labels = ([(k, f"plain words {k} {'grumblefoo' if k % 4 == 0 else ''}") for k in range(200)], [(k, int(k % 4 == 0)) for k in range(200)])
        model = toxicity.fit(C.frame(spark, docs), spark.createDataFrame(labels, "doc_id long, toxic int"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert model["terms"] == ["grumblefoo"]
    for name, plan in plans:
        for line in plan.split("\n"):
            assert not ("Exchange" in line and "Broadcast" not in line and "text" in line), (name, line)
    by = dict(plans)
    assert "Exchange" not in by["word_facts"] and "text" not in by["clean_words"]


def test_toxicity_of_very_long_texts(spark):
    model = {"terms": ["grumblefoo"], "weights": {(0, 0): 5.0}, "beta": np.array([1.0, 0, 0, 0, 0, 0, -2.0])}
    long = "plain " * 400_000
    rows = spark.createDataFrame([(1, long + "grumblefoo"), (2, long), (3, "grumblefoo" * 50_000)], "doc_id long, text string")
    got = {r.doc_id: r.s for r in rows.select("doc_id", toxicity.scorer(spark, model).alias("s")).collect()}
    assert got[1] > 0.9 and got[2] < 0.2 and got[3] < 0.2


def test_quotation_and_abuse_are_told_apart():
    quoted = lambda s, k: toxicity.is_quoted(s.split(), k)
    assert quoted('they put "you utter moron" on the wall', 4)
    assert quoted("the report said moron twice", 3)
    assert not quoted("you are a moron really", 3)
    assert not quoted('"fine" he is a moron', 4)


def test_toxicity_learns_misspellings_and_spares_quotation(spark):
    rnd = random.Random(1)
    docs, labels = [], []
    for k in range(400):
        text = C.words(rnd, 30).split()
        toxic = k % 4 == 0
        if toxic:
            text.insert(rnd.randrange(30), rnd.choice(["grumblefoo", "snarkwit"]))
        elif k % 4 == 1:
            text[3:3] = ['"you', rnd.choice(["grumblefoo", "snarkwit"]) + '"']
        docs.append((k, " ".join(text)))
        labels.append((k, 0, int(toxic)))
    new = [(1000, "hello you grumblefo there"), (1001, 'he read "the snarkwit" aloud'), (1002, "plain words here"),
           (1003, None), (1004, ""), (None, "you snarkwitt"), (1002, "plain words here")]
    lab = spark.createDataFrame(labels + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    got = toxicity.score_documents(C.clashing(spark, new), C.frame(spark, docs), lab).collect()
    assert len(got) == len(new) and all(0 <= r.score <= 1 for r in got)
    flags = {(r.doc_id): r.predicted for r in got}
    assert flags == {1000: 1, 1001: 0, 1002: 0, 1003: 0, 1004: 0, None: 1}
    empty = toxicity.score_documents(C.frame(spark, new), C.frame(spark, []), lab.limit(0)).collect()
    assert {r.score for r in empty} == {0.0}
    assert toxicity.score_documents(C.frame(spark, []), C.frame(spark, docs), lab).count() == 0


def test_lexicon_is_alike_whether_clean_texts_are_sampled(spark):
    rnd = random.Random(3)
    docs, labels = [], []
    for k in range(900):
        toxic = k % 9 == 0
        extra = ("grumblefoo" if k % 8 == 0 else "snarkwit") if toxic else "" if k % 7 else "mildword"
        docs.append((k, f"{C.words(rnd, 25)} {extra}"))
        labels.append((k, int(toxic)))
    labels += [(5000 + k, k % 2) for k in range(600)]  # labels of rows that are not learned from
    frames = C.frame(spark, docs), spark.createDataFrame(labels, "doc_id long, toxic int")
    for per_class in (10_000, 110):
        assert toxicity.fit(*frames, per_class)["terms"] == ["grumblefoo", "snarkwit"]
    _, weights, _ = toxicity.training_sample(*frames, 110)
    assert weights == {0: 800 / 110, 1: 1.0}


def test_toxicity_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    train = docs.filter(id_crc() % 4 != 2)
    test = docs.filter(id_crc() % 4 == 2)
    rows = toxicity.score_documents(test, train, labels).join(labels, "doc_id").collect()
    clean = [r.predicted for r in rows if r.toxic == 0]
    assert sum(clean) <= 0.05 * len(clean)
    toxic, rest = ([r.score for r in rows if r.toxic == y] for y in (1, 0))
    auc = np.mean([(a > b) + (a == b) / 2 for a in toxic for b in rest])
    assert auc > 0.75  # 37 toxic texts to learn from


# ------------------------------------------------------------------ language id

def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.identify(docs.filter(id_crc() % 3 == 1), docs.filter(id_crc() % 3 != 1)) \
        .join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.98


def test_language_edge_cases(spark):
    train = spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"),
                                   (3, None, "en"), (4, "x", None), (None, "the", "en")],
                                  "doc_id long, text string, lang string")
    rows = [(1, "the dog and cat"), (2, "die katze"), (3, None), (4, ""), (5, "12 34 !?"), (None, "und der"),
            (7, "the " * 50_000), (1, "the dog and cat")]
    got = {(r.doc_id): (r.lang_pred, r.score) for r in langid.identify(C.clashing(spark, rows), train).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: "en", 2: "de", 3: "und", 4: "und", 5: "und", None: "de", 7: "en"}
    assert all(0 <= s <= 1 for _, s in got.values()) and got[3][1] == 0
    none = langid.identify(C.frame(spark, rows), train.limit(0)).collect()
    assert {(r.lang_pred, r.score) for r in none} == {("und", 0.0)}
    assert langid.identify(C.frame(spark, []), train).count() == 0


def test_ngram_counts_equal_a_plain_count():
    texts = ["Ab c", "", "é"]
    grams, bounds = langid.ngram_buckets(texts, 1 << 15)
    one, _ = langid.ngram_buckets(["ab c"], 1 << 15)
    assert list(bounds) == [0, 4, 6, 6, 8, 9]
    for a, b in zip(grams, one):
        assert list(a[:4]) == list(b[:4])


# ------------------------------------------------------------------ decontamination

ITEMS = [(1, "Anna Berg walked 12 km in 3 hours. Then she rested by the old mill near Bristol for a while."),
         (2, "A train leaves the station with 40 passengers and stops twice before it reaches the coast at noon."),
         (3, "Short question here"), (4, None), (5, ""),
         (6, "A train leaves the station with 40 passengers and stops twice before it reaches the coast at noon.")]


def test_decontamination_cases(spark):
    rnd = random.Random(8)
    pad = lambda: C.words(rnd, 30)
    again = ITEMS[0][1].replace("Anna", "Greta").replace("12", "57").replace("km", "miles").replace("Bristol", "Leeds")
    rows = [(10, f"{pad()} {ITEMS[0][1]} {pad()}"), (11, f"{pad()}. {again} {pad()}"), (12, pad()),
            (13, ITEMS[1][1].upper()), (14, f"{pad()} short, question here {pad()}"), (15, None), (16, ""),
            (17, " ".join(ITEMS[1][1].split()[:8]) + " " + pad()), (None, ITEMS[1][1]), (10, pad()),
            (18, pad() + " " + ITEMS[1][1] + " " + C.words(rnd, 5000))]
    items = spark.createDataFrame([(i, t, 9) for i, t in ITEMS], "item_id long, text string, place int")
    got = {(r.doc_id, r.item_id): r.exact for r in decontam.contaminated(C.clashing(spark, rows), items).collect()}
    assert {k: got[k] for k in got if k[0] in (10, 11)} == {(10, 1): True, (11, 1): False}
    # Items 2 and 6 are one class, which 2 stands for.
    assert {k for k in got if k[0] not in (10, 11)} == {(13, 2), (14, 3), (None, 2), (18, 2)}
    kept = decontam.remove_contaminated(C.clashing(spark, rows), items)
    assert kept.columns == C.clashing(spark, rows).columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id not in (13, None)) == [10, 12, 15, 16, 17]
    assert decontam.contaminated(C.frame(spark, rows), items.limit(0)).count() == 0
    assert decontam.remove_contaminated(C.frame(spark, rows), items.limit(0)).count() == len(rows)
    assert decontam.contaminated(C.frame(spark, []), items).count() == 0


def test_copies_in_any_casing_and_lists_of_numbers_are_found(spark):
    numbers = "Sort the numbers 12, 5, 9, 33, 7, 81, 4, 62, 18, 27, 3, 45"
    titled = "The Old Mill Near The River Turns Slowly All Day Long And Night"
    items = spark.createDataFrame([(1, numbers), (2, ITEMS[1][1]), (3, titled)], "item_id long, text string")
    rows = [(1, "so then: " + numbers + ". thanks"), (2, ITEMS[1][1].upper()), (3, "see " + ITEMS[1][1].title()),
            (4, titled.upper()), (5, titled.lower()), (6, "1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14"), (7, titled)]
    got = {(r.doc_id, r.item_id): r.exact for r in decontam.contaminated(C.frame(spark, rows), items).collect()}
    assert got == {k: True for k in [(1, 1), (2, 2), (3, 2), (4, 3), (5, 3), (7, 3)]}
    assert [r.doc_id for r in decontam.remove_contaminated(C.frame(spark, rows), items).collect()] == [6]


def test_inconsistent_slots_are_no_match(spark):
    item = "Add 3 to the first box and 3 to the second box and then count 3 again slowly"
    same = item.replace("3", "8")
    mixed = "Add 1 to the first box and 2 to the second box and then count 9 again slowly"
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.doc_id for r in decontam.contaminated(C.frame(spark, [(1, same), (2, mixed), (3, item)]), items).collect()}
    assert got == {1, 3}


def test_one_changed_value_and_merged_values_are_found(spark):
    rnd = random.Random(9)
    long = f"{C.words(rnd, 20)} in 1990 {C.words(rnd, 15)} until 1990 {C.words(rnd, 12)}"
    merged = "Add 3 red balls to the first box and 5 green balls to the second one slowly"
    items = spark.createDataFrame([(1, long), (2, merged)], "item_id long, text string")
    rows = [(1, long.replace("until 1990", "until 1987")), (2, merged.replace("3", "4").replace("5", "4")), (3, long),
            (None, long.replace("in 1990", "in 2003"))]
    got = {(r.doc_id, r.item_id): r.exact for r in decontam.contaminated(C.frame(spark, rows), items).collect()}
    assert got == {(1, 1): False, (2, 2): False, (3, 1): True, (None, 1): False}


def test_planted_passages_are_found(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    texts, bench = docs.collect(), items.collect()
    want = {(d.doc_id, b.item_id) for d in texts for b in bench if b.text in d.text}
    members = {}
    for r in decontam.item_classes(decontam.benchmark_windows(items)).collect():
        members.setdefault(r["class"], set()).add(r.item_id)
    of = {min(m): m for m in members.values()}
    rows = decontam.contaminated(docs, items).collect()
    assert all(r.n_items == len(of[r.item_id]) for r in rows)
    assert want and want <= {(r.doc_id, i) for r in rows for i in of[r.item_id]}
    assert {(r.doc_id, r.item_id) for r in rows} == {(d, i) for d, k in want for i in of if k in of[i]}


def test_one_row_for_a_document_and_a_template_however_many_items_share_it(spark):
    item = "If {} sells {} apples for {} dollars in the morning and {} more at noon how many are left at night"
    names = ["Anna", "Greta", "Paul", "Hugo"]
    items = spark.createDataFrame([(k, item.format(names[k % 4], 100 + k, 300 + k, 700 + k)) for k in range(120)]
                                  + [(500, item.format("Anna", 5, 5, 5))], "item_id long, text string")
    rows = [(k, "so " + item.format(names[k % 3], 2000 + k, 4000 + k, 9000 + k)) for k in range(60)]
    got = decontam.contaminated(C.frame(spark, rows), items).collect()
    # A document also fits the item that repeats one number, if its own numbers were equal; here they are not.
    assert sorted((r.doc_id, r.item_id, r.n_items, r.exact) for r in got) == [(k, 0, 120, False) for k in range(60)]


def test_decontamination_of_repeated_rows_and_long_items(spark):
    rnd = random.Random(3)
    long = C.words(rnd, 3000)
    items = spark.createDataFrame([(1, long), (1, long), (2, ITEMS[1][1])], "item_id long, text string")
    rows = [(1, long), (1, long), (2, "a " + ITEMS[1][1]), (2, "a " + ITEMS[1][1]), (3, long[:len(long) // 2])]
    got = decontam.contaminated(C.frame(spark, rows), items).collect()
    assert sorted((r.doc_id, r.item_id, r.n_items) for r in got) == [(1, 1, 1), (2, 2, 1)]
    assert [r.doc_id for r in decontam.remove_contaminated(C.frame(spark, rows), items).collect()] == [3]


def brute_contaminated(doc, item):
    """Coverage of an item by a document: windows of typed tokens with one value a slot on a diagonal, or of equal words."""
    def typed(words):
        out = []
        for k, w in enumerate(words):
            token = w.strip(decontam.EDGES)
            name = k > 0 and token[:1].isupper() and not words[k - 1].rstrip("\"'”’»)]").endswith((".", "!", "?"))
            hole = decontam.placeholder(token, token.casefold())
            out.append((hole or (decontam.NAME if name else token.casefold()), bool(hole or name), token.casefold()))
        return out
    d, t = typed(doc.split()), typed(item.split())
    w = min(decontam.WINDOW, len(t))
    covered = set()
    for shift in range(-len(t), len(d)):
        fit = {}
        for p in range(len(t) - w + 1):
            q = p + shift
            if q < 0 or q + w > len(d):
                continue
            a, b = t[p:p + w], d[q:q + w]
            if [x[2] for x in a] == [x[2] for x in b]:
                fit[p] = []
            elif [x[0] for x in a] == [x[0] for x in b] and not all(x[1] for x in a):
                fit[p] = [(x[2], y[2]) for x, y in zip(a, b) if x[1]]
        votes = {}
        for pairs in fit.values():
            for pair in set(pairs):
                votes[pair] = votes.get(pair, 0) + 1
        # Windows of equal words that have slots vote too: as templates they are there as well.
        for p, pairs in fit.items():
            if not pairs and not all(x[1] for x in t[p:p + w]):
                for x in {x[2] for x in t[p:p + w] if x[1]}:
                    votes[x, x] = votes.get((x, x), 0) + 1
        main = {}
        for (was, new), n in votes.items():
            main[was] = min(main.get(was, (0, "")), (-n, new))
        for p, pairs in fit.items():
            if all(main[was][1] == new for was, new in pairs):
                covered |= set(range(p, p + w))
    return len(covered) / len(t) if t else 0.0


@pytest.mark.parametrize("seed", range(3))
def test_decontamination_equals_brute_force(spark, seed):
    rnd = random.Random(seed)
    vocabulary = ["the", "cat", "sat", "on", "Anna", "Paul", "Mat", "7", "12", "km", "and", "then", "ran.", "slowly", "three"]
    items = [(k, " ".join(rnd.choices(vocabulary, k=rnd.randrange(3, 16)))) for k in range(25)]
    docs = []
    for k in range(60):
        words = rnd.choice(items)[1].split()
        words = [rnd.choice(vocabulary) if rnd.random() < 0.06 else {"7": "9", "Anna": "Zoe"}.get(w, w) if k % 2 else w for w in words]
        docs.append((k, " ".join(rnd.choices(vocabulary, k=5) + words + rnd.choices(vocabulary, k=5))))
    frame = spark.createDataFrame(items, "item_id long, text string")
    members = {}
    for r in decontam.item_classes(decontam.benchmark_windows(frame)).collect():
        members.setdefault(r["class"], set()).add(r.item_id)
    of = {min(m): m for m in members.values()}
    got = {(r.doc_id, i) for r in decontam.contaminated(C.frame(spark, docs), frame).collect() for i in of[r.item_id]}
    want = {(d, i) for d, text in docs for i, item in items if brute_contaminated(text, item) >= decontam.COVERAGE}
    # The plain windows of a class are those of all its items, so a few more may be met.
    assert want <= got and len(got) <= len(want) + 2 and len(want) > 20
