"""Command line: `python -m loomtext.plans.cli classify|score|tag|cluster|parse ...`."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ccg, cluster, counts, hmm, keyed, naive_bayes, perceptron, tagdict
from ..sources import corpora


def classify(spark: SparkSession, train: str, predict: str, method: str = "nb", lam: float = 1.0, variant: int = 1, aggressiveness: float = 20.0, rounds: int = 1000) -> DataFrame:
    """(doc_id, label, score) for every label of each line to predict, by naive Bayes or a perceptron. More than two labels
    always learn by multi-class passive-aggressive steps."""
    known = corpora.long_features(corpora.csv_instances(corpora.read_lines(spark, train)))
    wanted = corpora.long_features(corpora.csv_instances(corpora.read_lines(spark, predict)))
    if method == "nb":
        return naive_bayes.Trainer.of(known).model(lam).classify(wanted.select("doc_id", "feature")).withColumnRenamed("logp", "score")
    if method not in ("perceptron", "pa-perceptron"):
        raise ValueError(f"no such method: {method}")
    words, labels = perceptron.interned(known, "feature").cache(), perceptron.interned(known, "label", 0).cache()
    classes, width = labels.count(), words.count() + 1
    kind = "pa_multi" if classes > 2 else "pa" if method == "pa-perceptron" else "binary"
    w = perceptron.train(perceptron.instances(known, words, labels), classes, width, kind, rounds, variant=variant, aggressiveness=aggressiveness)
    numbered = wanted.join(words, F.col("feature") == F.col("value"), "left").groupBy(F.col("doc_id").alias("id"))
    data = numbered.agg(F.sort_array(F.collect_set("number")).cast("array<int>").alias("features"))
    s = perceptron.score(data, w, classes, binary=kind != "pa_multi")
    return s.join(labels, F.col("class") == F.col("number")).select(F.col("id").alias("doc_id"), F.col("value").alias("label"), "score")


def accuracy(spark: SparkSession, gold: str, predicted: str) -> DataFrame:
    """One row: right and all lines; a gold line ends in its label, a predicted one begins with it."""
    g = corpora.csv_instances(corpora.read_lines(spark, gold)).select("doc_id", F.col("label").alias("gold"))
    p = corpora.read_lines(spark, predicted).select(F.col("line_no").alias("doc_id"), F.regexp_extract("value", r"^\s*(\S+)", 1).alias("predicted"))
    return keyed.zip_strict(g, p, [], "doc_id").agg(F.count_if(F.col("gold") == F.col("predicted")).alias("correct"), F.count("*").alias("total"))


def tag(spark: SparkSession, train: str, text: str, lam: float = 1.0, constrained: bool = False) -> DataFrame:
    """Tokens of a raw corpus with the tags of a supervised model."""
    key = F.concat_ws("#", "path", "seq_id").alias("seq_id")
    gold = corpora.tagged_stream(corpora.read_lines(spark, train)).select(key, "pos", "sym", "tag")
    raw = corpora.raw_stream(corpora.read_lines(spark, text)).select(key, "pos", "sym")
    smooth = counts.eisner(lam, counts.add_lambda(1.0))
    return hmm.tag(raw, hmm.train_supervised(gold, smooth, smooth, tagdict.simple(gold) if constrained else None))


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="loomtext")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("classify")
    c.add_argument("--train", required=True)
    c.add_argument("--predict", required=True)
    c.add_argument("--method", default="nb", choices=["nb", "perceptron", "pa-perceptron"])
    c.add_argument("--lambda", dest="lam", type=float, default=1.0)
    c.add_argument("--variant", type=int, default=1, choices=[0, 1, 2])
    c.add_argument("--aggressiveness", type=float, default=20.0)
    s = sub.add_parser("score")
    s.add_argument("gold")
    s.add_argument("predicted")
    t = sub.add_parser("tag")
    t.add_argument("--train", required=True)
    t.add_argument("--text", required=True)
    t.add_argument("--constrained", action="store_true")
    k = sub.add_parser("cluster")
    k.add_argument("points")
    k.add_argument("-k", type=int, default=3)
    k.add_argument("--numbers", type=int, default=2)
    k.add_argument("--distance", default="euclidean", choices=["euclidean", "manhattan", "cosine"])
    k.add_argument("--transform", default="ident", choices=["ident", "zscore", "pca"])
    g = sub.add_parser("parse")
    g.add_argument("lexicon")
    g.add_argument("testbed")
    g.add_argument("--rules", default="AB", choices=sorted(ccg.RULES))
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("loomtext").getOrCreate()
    if a.command == "classify":
        d = classify(spark, a.train, a.predict, a.method, a.lam, a.variant, a.aggressiveness)
        rows = d.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "label"))).alias("x")).orderBy("doc_id")
        for r in rows.toLocalIterator():
            print(" ".join(f"{x.label} {-x.s:.6f}" for x in r.x))
    elif a.command == "score":
        r = accuracy(spark, a.gold, a.predicted).first()
        print(f"accuracy {100 * r.correct / max(r.total, 1):.2f} ({r.correct}/{r.total})")
    elif a.command == "tag":
        for r in tag(spark, a.train, a.text, constrained=a.constrained).orderBy("seq_id", "pos").toLocalIterator():
            print(f"{r.sym}/{r.tag}")
    elif a.command == "cluster":
        points = cluster.transform(a.transform, corpora.point_lines(corpora.read_lines(spark, a.points), a.numbers))
        disp, centroids = cluster.kmeans(points, a.k, a.distance)
        print(f"dispersion {disp:.6f}", *(" ".join(f"{x:.6f}" for x in c) for c in centroids), sep="\n")
    else:
        with open(a.lexicon) as f:
            lex = f.read().splitlines()
        lines = corpora.read_lines(spark, a.testbed).where("trim(value) <> ''")
        for r in ccg.testbed(lines, "value", lex, a.rules).toLocalIterator():
            print("SUCCESS" if r.success else "FAILURE", r.sentence)


if __name__ == "__main__":
    main()
