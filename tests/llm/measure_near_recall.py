"""Recall of near_dedup.classes() at its defaults against all pairs: python -m tests.llm.measure_near_recall [SF_DIR].

Every pair of distinct texts that shares a shingle is scored exactly, by the module's weights and by plain Jaccard. Printed:
of the pairs at or over 0.8 (in steps), the share that has one class. Needs the whole table in one process: small tables only.
"""

import math
import sys
import tempfile
from collections import Counter, defaultdict

import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from skeinframe.llm import near_dedup


def vectors(rows):
    """{smallest id of a text: Counter of shingle weights}, and each id's."""
    texts = {}
    for i, t in rows:
        if i is not None and t and t.split():
            texts[t] = min(i, texts.get(t, i))
    docs = [t.encode().lower().split() for _, t in rows]
    df = Counter(w for d in docs for w in set(d))
    idf = {w: round(16 * (1 + math.log(len(rows) / c) / math.log(len(rows) + 1))) for w, c in df.items()}
    out = {}
    for t, i in texts.items():
        w, v = t.encode().lower().split(), Counter()
        for k in range(len(w) - 4):
            v[hash(tuple(w[k : k + 5]))] += sum(idf[x] for x in w[k : k + 5])
        out[i] = v
    return out


def near_pairs(found):
    """(i, j, weighted, plain) of all pairs that share a shingle and reach 0.8 in either similarity."""
    postings = defaultdict(list)
    for i, v in sorted(found.items()):
        for s, w in v.items():
            postings[s].append((i, w))
    total = {i: sum(v.values()) for i, v in found.items()}
    for i, v in found.items():
        both, shared = Counter(), Counter()
        for s, w in v.items():
            for j, x in postings[s]:
                if j >= i:
                    break
                both[j] += min(w, x)
                shared[j] += 1
        for j, b in both.items():
            weighted, plain = b / (total[i] + total[j] - b), shared[j] / (len(v) + len(found[j]) - shared[j])
            if max(weighted, plain) >= 0.8:
                yield i, j, weighted, plain


def main(folder):
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.local.dir", tempfile.mkdtemp(prefix="spark-")).getOrCreate()
    rows = list(zip(*(pq.read_table(f"{folder}/documents.parquet")[c].to_pylist() for c in ("doc_id", "text")), strict=True))
    classes = {r.doc_id: r.class_id for r in near_dedup.classes(spark.read.parquet(f"{folder}/documents.parquet")).collect()}
    pairs = list(near_pairs(vectors(rows)))
    for name, at in (("weighted", 2), ("plain", 3)):
        for low, high in ((0.8, 1.01), (0.8, 0.82), (0.82, 0.85), (0.85, 0.9), (0.9, 1.01)):
            own = [p for p in pairs if low <= p[at] < high]
            joined = sum(classes[p[0]] == classes[p[1]] for p in own)
            print(f"{name} similarity {low} to {min(high, 1)}: {joined} of {len(own)} pairs in one class" + (f", {joined / len(own):.4f}" if own else ""))
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1")
