"""The pipeline's rows after every stage, compared with plain Python on planted documents."""

import hashlib
import inspect
import math
import random
from collections import Counter, defaultdict

import corpus_pipeline
from wayledger.llm import mixing
from wayledger.llm.queries import MIX_EXPONENT, tokenizer_file

WORDS = {
    "en": "the and with house river walking through their children always something weather thought should which little".split(),
    "de": "der und nicht straße fluss gehen durch kinder immer etwas wetter gedanke sollte welche kleine über".split(),
}


def planted():
    """(doc_id, text, lang, source, label, kind): clean texts, near copies of some, texts of low quality, texts in no language."""
    draw, docs = random.Random(5), []
    text = lambda lang, n: " ".join(draw.choice(WORDS[lang]) + draw.choice(["", "", ","]) for _ in range(n)) + "."
    for i in range(240):
        lang = "de" if i % 3 == 0 else "en"
        docs.append((text(lang, 120), lang, "web" if i % 4 else "books", 1, f"clean {i}"))
    for i in range(0, 40, 4):
        for k in (1, 2):
            words = docs[i][0].split()
            words[30 * k] = "changed"
            docs.append((" ".join(words), docs[i][1], "web", 1, docs[i][4]))
    for i in range(80):
        spam = " ".join(draw.choice(["BUY", "NOW!!!", "$$$", "CLICK", "FREE"]) for _ in range(100))
        docs.append((spam, "en", "web", 0, "rejected"))
    for i in range(20):
        docs.append((" ... " * (5 + i), None, "web", 1, "no language"))
    draw.shuffle(docs)
    return [(i, *d) for i, d in enumerate(docs)]


def copies(docs, seed):
    """How often each document stands in the mixed corpus: the Poisson quantile of a hash of its id."""
    sizes = Counter()
    for _, text, _, source, _, _ in docs:
        sizes[source] += len(text) + 1
    whole, powers = sum(sizes.values()), {s: n**MIX_EXPONENT for s, n in sizes.items()}
    out = {}
    for i, _, _, source, _, _ in docs:
        rate = whole * powers[source] / sum(powers.values()) / sizes[source]
        u = int(hashlib.md5(f"{seed}:{i}".encode()).hexdigest()[:13], 16) / 2**52
        k, p = 0, math.exp(-rate)
        c = p
        while c <= u:
            k += 1
            p *= rate / k
            c += p
        out[i] = k
    return {i: k for i, k in out.items() if k}


def test_rows_after_every_stage(spark, tmp_path):
    from tokenizers import Tokenizer

    docs = planted()
    table = [(i, text, lang, source, len(text)) for i, text, lang, source, _, _ in docs]
    spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d[0], d[4]) for d in docs], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    stages, now = dict(corpus_pipeline.STAGES), spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert list(stages) == ["quality", "language", "near_duplicates", "mixing", "packing"]

    def after(name, df):
        return corpus_pipeline.stored(stages[name](spark, df, str(tmp_path)), name)

    now = after("quality", now)
    good = [d for d in docs if d[4] == 1]
    assert sorted(r.doc_id for r in now.collect()) == [d[0] for d in good]

    now = after("language", now)
    known = [d for d in good if d[2] is not None]
    assert len(known) < len(good) and sorted(r.doc_id for r in now.collect()) == [d[0] for d in known]

    now = after("near_duplicates", now)
    kept = {r.doc_id for r in now.collect()}
    groups = defaultdict(list)
    for d in known:
        groups[d[5]].append(d[0])
    assert max(map(len, groups.values())) == 3 and now.count() == len(groups)
    assert all(len(kept & set(g)) == 1 for g in groups.values())

    left = [d for d in known if d[0] in kept]
    now = after("mixing", now)
    want = copies(left, inspect.signature(mixing.mix).parameters["seed"].default)
    assert Counter(r.doc_id for r in now.collect()) == want

    library = Tokenizer.from_file(tokenizer_file())
    pieces, used = after("packing", now).collect(), defaultdict(list)
    lengths, sequences = Counter(), Counter()
    for r in pieces:
        lengths[r.doc_id] += r.length
        sequences[r.sequence_id] += r.length
        used[r.doc_id].append(r.start)
    texts = {d[0]: d[1] for d in left}
    assert lengths == {i: k * (len(library.encode(texts[i], add_special_tokens=False).ids) + 1) for i, k in want.items()}
    assert all(starts.count(0) == want[i] for i, starts in used.items()) and max(sequences.values()) <= 4096

    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    key = lambda r: (r.doc_id, r.start, r.length, r.ids_crc32)
    assert Counter(map(key, whole)) == Counter(map(key, pieces))
