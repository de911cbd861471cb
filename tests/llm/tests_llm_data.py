"""A small corpus whose survivors are known."""

import random


def write_tables(spark, folder):
    rng = random.Random(9)
    vocabulary = [f"w{k}" for k in range(3000)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    item = text(30)
    docs, labels, want = [], [], []
    for i in range(240):
        body = text(60)
        if i % 6 == 0:  # toxic
            body += " idiot moron scum"
        elif i % 6 == 1:  # near copy of the next but three
            docs.append((1000 + i, body + " more words", "en", f"s{i % 3}", 0))
        elif i % 24 == 2:  # leak
            body += " " + item
        docs.append((i, body, "en", f"s{i % 3}", 0))
        labels.append((i, 1, int(i % 6 == 0)))
        if i % 6 and i % 24 != 2:
            want.append(i)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return sorted(want)
