from pyspark.sql import functions as F

from pairlens.operators import sinks as sk
from pairlens.sources import catalogue as cat
from pairlens.sources import corpus, kb, records, training

import pytest


def write(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def test_system_output(spark, tmp_path):
    path = write(
        tmp_path, "out.txt",
        "instance: A\tB score:0.9\nsentence: A was owned by B\npattern_bef: x y\npattern_bet: was owned by\n"
        "pattern_aft: z\npassive voice: True\n\n\ninstance: C\tD score:0.2\nsentence: s\npattern_bet: owns\npassive voice: False\n\n"
        "instance: broken\n\ninstance: Ü\tF score:0.8\nsentence: t\npattern_bet: owns\npassive voice: False",
    )
    got = records.read_system_output(spark, path, 0.5, "owns")
    assert rows(got, "e1", "e2", "score", "bef", "aft", "passive") == [
        ("B", "A", 0.9, "x y", "z", True), ("Ü", "F", 0.8, "", "", False),
    ]
    kept = records.read_system_output(spark, path, 0.5, "owns2")
    assert ("A", "B") in rows(kept, "e1", "e2")
    assert rows(records.bad_records(records.read_records(spark, path))) == [("instance: broken",)]


def test_classified_output_every_occurrence(spark, tmp_path):
    path = write(
        tmp_path, "c.txt",
        "instance: A\tB\nsentence: <ORG>A</ORG> owns <ORG>B</ORG> and A sold B\nrel_type: owns\n\n"
        "instance: B\tA\nsentence: <ORG>A</ORG> owns <ORG>B</ORG>\nrel_type: owns\n\n",
    )
    got = records.read_classified_output(spark, path)
    assert sorted(r.bet for r in got.filter("e1 = 'A'").collect()) == ["", "owns", "owns B and A sold", "sold"]
    assert [r.bet for r in got.filter("e1 = 'B'").collect()] == [""]


def test_kb_readers(spark, tmp_path):
    nt = write(
        tmp_path, "dbpedia_location.txt",
        "<http://dbpedia.org/resource/Acme_(firm)> <loc> <http://dbpedia.org/resource/Paris,_France> .\nbad line\n",
    )
    lines = spark.read.text(nt)
    assert rows(kb.parse_ntriples(lines)) == [("Acme", "France"), ("Acme", "Paris")]
    assert rows(kb.bad_lines(lines, "dbpedia")) == [("bad line",)]
    yago = spark.createDataFrame([("<en/A_(x)>\trel\t<B.,_\"C\">",)], "value string")
    assert rows(kb.parse_yago(yago)) == [("A", '"C"'), ("A", "B")]
    free = spark.createDataFrame([("#c",), ("A\tr\tB ",)], "value string")
    assert rows(kb.parse_family(free, "freebase", "spouse"), "e1", "e2") == [("A", "B"), ("B", "A")]
    assert rows(kb.parse_family(free, "freebase", "founder"), "e1", "e2") == [("B", "A")]
    assert rows(kb.parse_family(free, "freebase", "owns"), "e1", "e2") == [("A", "B")]
    manual = spark.createDataFrame([("A\tB",), ("# x\ty",)], "value string")
    assert rows(kb.parse_family(manual, "manual", "owns2"), "e1", "e2") == [("A", "B")]


def test_orientation_is_per_file(spark):
    line = "<http://dbpedia.org/resource/X> <r> <http://dbpedia.org/resource/Y> ."
    lines = spark.createDataFrame([(line,)], "value string")
    assert rows(kb.parse_family(lines, "dbpedia", "located-in", "dbpedia_country.txt"), "e1", "e2") == [("X", "Y")]
    assert rows(kb.parse_family(lines, "dbpedia", "located-in", "dbpedia_capital.txt"), "e1", "e2") == [("Y", "X")]


def test_load_kb(spark, tmp_path):
    for names in cat.KB_FILES["studied"].values():
        for name in names:
            write(tmp_path, name, "")
    write(tmp_path, "manually_studied.txt", "Bob\tMIT\n# no\nBob\tMIT\n")
    write(tmp_path, "yago_graduatedFrom.txt", "<Ann>\tgraduatedFrom\t<MIT>\n")
    assert rows(kb.load_kb(spark, str(tmp_path), ["studied"])) == [("studied", "Ann", "MIT"), ("studied", "Bob", "MIT")]
    with pytest.raises(ValueError):
        kb.load_kb(spark, str(tmp_path), ["unknown"])


def test_training_and_features(spark, tmp_path):
    path = write(tmp_path, "t.txt", "# c\n\nid:7\towns\tA\tB\t<ORG>A</ORG> owns \"it\" <ORG>B</ORG>\nid\towns\tA\tB\tx\nshort\n")
    assert rows(training.read_training(spark, path)) == [(7, "owns", "A", "B", '<ORG>A</ORG> owns "it" <ORG>B</ORG>')]
    path = write(tmp_path, "f.txt", "3\towns\ta  b c\nbroken\n")
    assert rows(training.read_features(spark, path)) == [(3, "owns", ["a", "b", "c"])]
    path = write(tmp_path, "s.txt", "e1: A\ne2: B\nsentence: x\nshingles: p q\n\n")
    assert rows(records.read_shingle_records(spark, path)) == [("A", "B", "x", ["p", "q"])]
    path = write(tmp_path, "u.txt", "# c\n\n one \ntwo")
    assert rows(corpus.read_unlabelled_sentences(spark, path)) == [("one",), ("two",)]


def test_facts_to_training(spark, tmp_path):
    block = "instance : A\tB\t0.9\nsentence : s{n}\nbef_words: \nbet_words: x\naft_words: \npassive voice: {p}\n\n"
    write(tmp_path, "founder_positive.txt", block.format(n=1, p="True") + block.format(n=2, p="False"))
    write(tmp_path, "owns_positive.txt", block.format(n=3, p="True"))
    read = lambda swap: rows(training.read_facts_as_training(spark, str(tmp_path), swap), "rel_type", "e1", "sentence")
    assert read(False) == [("founder", "A", "s2"), ("owns", "A", "s3")]
    assert read(True) == [("founder", "A", "s2"), ("owns", "B", "s3")]


def test_readers_set_bad_rows_aside(spark):
    """Every row is good or bad, never both and never neither; null rows are bad where a line without content is no comment."""
    lines = spark.createDataFrame(
        [("id:1\towns\tA\tB\ts",), ("id:x\towns\tA\tB\ts",), ("id:2\towns",), ("2\towns\ta b",), ("x\towns\ta",), (None,)], "value string"
    )
    assert [r.rel_id for r in training.parse_training(lines).collect()] == [1]
    assert training.bad_training(lines).count() == 4
    assert [r.rel_id for r in training.parse_features(lines).collect()] == [2]
    assert training.bad_features(lines).count() == 5
    texts = [
        "instance: A\tB\nsentence: s\nrel_type: owns", "instance: A", "instance: A\tB\t0.5", "e1: A\ne2: B\nshingles: a b", "e1: A", "", None,
    ]
    found = spark.createDataFrame([(t, "owns_x.txt") for t in texts], "value string, file_name string")
    for good, bad in (
        (records.parse_classified_output, records.bad_classified_output),
        (records.parse_shingle_records, records.bad_shingle_records),
        (training.parse_evaluated_facts, training.bad_evaluated_facts),
    ):
        assert good(found).count() == 1 and bad(found).count() == len(texts) - 1


def test_sinks_reuse_by_parameters(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.createDataFrame([("ORG", "LOC", "a")], "e1_type string, e2_type string, e1 string")

    for window in (2, 2, 3):
        assert sk.materialise_superset(spark, str(tmp_path), {"corpus": "x/y", "window": window}, build).count() == 1
    assert len(calls) == 2
    rows_ = spark.createDataFrame([("a", "owns"), ("b", "None")], "e1 string, rel_type string")
    sk.write_by_relation(rows_, str(tmp_path / "by"))
    assert spark.read.parquet(str(tmp_path / "by")).filter(F.col("rel_type") == "owns").count() == 1


def test_catalogue(spark):
    assert cat.relation_catalogue(spark).count() == 12
    assert cat.argument_types(["spouse"]) == [("PER", "PER")]
    with pytest.raises(ValueError):
        cat.check_relations(["nope"])
