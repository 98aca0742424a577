import hashlib
import random

from pyspark.sql import functions as F

from quern.llm import encoding

CLEAN = [
    "Le chiffre d’affaires s’est élevé à 5 € près de l’été, où la marge a déçu.", "Die Größe der Lagerfläche blieb über März unverändert für Grünau.",
    "La inflación en la región según el índice fue del 5,5 % por año.", "The café’s outlay – 18 °C – was ₹5 crore… as naïve as £629.", "Объём перевозок вырос на 3 процента за период.",
    "बोर्ड ने ₹27 crore के पूंजीगत व्यय को मंज़ूरी दी। आय बढ़ी।", "SÃO MANTIDAS AS PROJEÇÕES. ÂMBITO: ação.", "plain ascii only",
]


def wrong(text, page, times=1):
    table = encoding._page(page)
    for _ in range(times):
        text = "".join(table.get(b, chr(b)) if b > 127 else chr(b) for b in text.encode())
    return text


def corpus():
    rnd = random.Random(2)
    rows, truth = [], {}
    for i in range(700):
        text = " ".join(rnd.choices(CLEAN, k=rnd.randint(1, 4)))
        shown = text
        if i % 9 == 0:
            shown = wrong(text, rnd.choice(["cp1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1251"]), rnd.choice([1, 1, 2]) if i % 2 else 1)
        elif i % 31 == 0:
            words = text.split(" ")  # only a part is damaged
            shown = " ".join(wrong(w, "cp1252") if j % 3 == 0 else w for j, w in enumerate(words))
        elif i % 41 == 0:
            shown = text.replace("é", "�").replace("ü", "�").replace("₹", "�")
        rows.append((i, shown, rnd.choice(["s1", "s2", None])))
        if shown != text:
            truth[i] = "" if "�" in shown else hashlib.sha256(text.encode()).hexdigest()
    return rows, truth


def test_restored(spark):
    rows, truth = corpus()
    rows += [(-1, None, "s1"), (-2, "", "s1"), (-3, "   ", None), (-4, "long " * 60_000, "s2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("restored", F.lit("clash")).withColumn("units", F.lit(1))
    got = {r["doc_id"]: r["restored_sha256"] for r in encoding.restored_hashes(docs).collect()}
    assert got == truth


def test_nothing_to_restore(spark):
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(CLEAN)], "doc_id long, text string, source string")
    assert encoding.restored_hashes(docs).isEmpty() and encoding.restored_hashes(docs.limit(0)).isEmpty()


def test_units():
    assert {(u, x[0]) for _, u, x in encoding.units_of("â‚¹")} == {("â‚¹", "₹")}
    assert encoding.units_of("ÇÕ") == () or all("ÇÕ" != u for _, u, _ in encoding.units_of("ÇÕ"))
    assert encoding.peeled(wrong("déjà ₹5", "cp1252", 2)) == wrong("déjà ₹5", "cp1252")


def swapped(text, own, read):
    return text.encode(own, "replace").decode(read, "replace")


SWAPS = [("cp1251", "latin-1"), ("koi8-r", "cp1251"), ("cp866", "cp1251"), ("cp1252", "cp437"), ("mac_roman", "cp1252")]
RUSSIAN = [
    "Объём перевозок вырос на 3 процента за отчётный период.", "Компания построила новый склад в Казани и открыла линию.", "Чистая прибыль группы снизилась из-за роста цен на топливо.",
    "Совет директоров утвердил бюджет на следующий год.", "Численность персонала составила 5400 человек.", "Выручка от услуг увеличилась благодаря новым клиентам.",
]
FRENCH = [
    "Le chiffre d'affaires s'est élevé à 5 millions, où la marge a déçu.", "La société a été créée près de Besançon en été.", "Les résultats définitifs ont été publiés après l'assemblée générale.",
    "Größe und Fläche blieben über März unverändert für Grünau.", "La inflación en la región fue del 5 por año según el índice.", "Où est passée la moitié des bénéfices dégagés à l'étranger ?",
]


def test_swapped_code_pages_and_unlisted_ones(spark):
    rnd = random.Random(9)
    rows, truth, n = [], {}, 0
    for kinds in (RUSSIAN, FRENCH):
        for _ in range(400):
            rows.append((n, " ".join(rnd.choices(kinds, k=4)), rnd.choice(["a", "b", None])))
            n += 1
    for i, (own, read) in enumerate(SWAPS):
        for _ in range(12):
            text = " ".join(rnd.choices(RUSSIAN if i < 3 else FRENCH, k=5))
            shown = swapped(text, own, read)
            if "�" in shown or "?" in text.encode(own, "replace").decode(own).replace(text, ""):
                continue
            rows.append((n, shown, f"s{i}"))
            truth[n] = hashlib.sha256(text.encode()).hexdigest()
            n += 1
    for _ in range(12):
        text = " ".join(rnd.choices(FRENCH, k=5))
        rows.append((n, wrong(text, "cp1253"), "utf"))
        truth[n] = hashlib.sha256(text.encode()).hexdigest()
        n += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r["restored_sha256"] for r in encoding.restored_hashes(docs).collect()}
    assert set(got) - set(truth) == set()
    assert len(truth) >= 60 and got == truth


def test_code_pages():
    assert {"cp1253", "koi8_u", "mac_cyrillic", "cp852"} <= set(encoding.CODE_PAGES) and not {"shift_jis", "utf_8", "cp037", "big5"} & set(encoding.CODE_PAGES)
