"""Toxicity: weighted finite-state transducers for insult, threat, target, negation and reported speech,
composed into one grammar that scores clauses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FOLDS = 5  # by crc32 of the id; fold 0 is never learned from
LABELLED = 40_000  # labelled rows of smallest hash that lexicon and weights are learned from, at most
STEM = (3, 6)  # code points of a stem: the beginning of a word
LEAST = 3  # toxic texts that a lexicon entry occurs in
SURE = 2.0  # standard errors that an entry's log odds must stay above 1

# Words of the grammar's closed classes in de, en, es, fr (fixed values).
TARGETS = frozenset("""you your yours yourself u ur he him his she her they them their these those this people everyone everybody du
dich dir dein deine ihr euch sie ihn ihm er alle leute tu tus te ti usted ustedes él ella ellos ellas gente toi vous
votre vos ton ta il elle ils elles gens""".split())
NEGATIONS = frozenset("""not no never neither nor without isn't aren't wasn't weren't don't doesn't didn't won't can't isnt arent dont
nicht kein keine keinen nie niemals ohne nunca jamás sin tampoco ne pas jamais sans aucun aucune""".split())
REPORTS = frozenset("""said says say saying told tells wrote writes claimed claims called reported reportedly quoted according alleged
sagte sagt sagten schrieb schreibt behauptete nannte laut dijo dice dijeron escribió afirmó llamó según dit disait
écrit affirme affirmait appelé selon""".split())
THREATS = frozenset("""kill killing hurt beat stab shoot strangle hang burn destroy töten umbringen schlagen erschießen verbrennen matar
golpear disparar quemar tuer frapper tirer brûler étrangler""".split())
PLANS = frozenset("""will shall gonna going i'll we'll i'm we're must should werde werden wird sollte muss voy vamos debe deben vais allons
vais va doit doivent""".split())
QUOTES = "\"“”«»„"
STOPS = ".!?\n"
BREAKS = ",;:()"

SYMBOLS = ("insult", "threat", "plan", "target", "negation", "report", "quote", "break", "stop")
# What a clause adds to the document's sums, by the state in which the grammar leaves it.
SUMS = ("insult", "aimed", "denied", "told", "threat")
PRIOR = (1.2, 0.5, -0.6, -0.4, 1.2)  # weights of the sums where labels say nothing
BASE = -2.0  # intercept where labels say nothing


def machine(states: int, start: int, arcs: dict[tuple[int, str], int]):
    """(start, next state by state and symbol): symbols without an arc leave the state as it is."""
    return start, [[arcs.get((s, x), s) for x in SYMBOLS] for s in range(states)]


# Each part follows one thing through the clauses of a sentence; a clause ends at a break, a sentence at a stop.
PARTS = {
    "insult": machine(2, 0, {(0, "insult"): 1, (1, "break"): 0, (1, "stop"): 0}),
    # a threat is a plan followed, in the same clause, by a violent verb
    "threat": machine(3, 0, {(0, "plan"): 1, (1, "threat"): 2, (1, "break"): 0, (2, "break"): 0, (1, "stop"): 0, (2, "stop"): 0}),
    "target": machine(2, 0, {(0, "target"): 1, (1, "break"): 0, (1, "stop"): 0}),
    # a negation denies what follows it in the clause: 1 a negation, 2 with a match behind it
    "negation": machine(3, 0, {(0, "negation"): 1, (1, "insult"): 2, (1, "threat"): 2, **{(s, x): 0 for s in (1, 2) for x in ("break", "stop")}}),
    # reported speech: 1 after a verb of saying up to the stop, 2 within quotation marks, over stops; with a match
    # in this clause 3 within marks, 4 behind them, 5 after a verb of saying
    "report": machine(6, 0, {(0, "report"): 1, (1, "stop"): 0, (0, "quote"): 2, (1, "quote"): 2, (2, "quote"): 0, (5, "quote"): 3,
                             (3, "quote"): 4, (4, "quote"): 3, (5, "break"): 1, (5, "stop"): 0,
                             **{(s, x): to for x in ("insult", "threat") for s, to in ((1, 5), (2, 3))},
                             **{(s, x): to for x in ("break", "stop") for s, to in ((3, 2), (4, 0))}}),
}


def compose(parts: dict):
    """Product of the machines, reachable states only: (next state by state and symbol, the parts' states of
    each, number of each)."""
    names = list(parts)
    first = tuple(parts[n][0] for n in names)
    number, states, table = {first: 0}, [first], []
    for at in states:  # grows while it is read
        row = []
        for x in range(len(SYMBOLS)):
            to = tuple(parts[n][1][s][x] for n, s in zip(names, at, strict=True))
            if to not in number:
                number[to] = len(states)
                states.append(to)
            row.append(number[to])
        table.append(row)
    return table, [dict(zip(names, s, strict=True)) for s in states], number


def _grammar():
    table, states, number = compose(PARTS)
    quoted = number[tuple(2 if n == "report" else PARTS[n][0] for n in PARTS)]
    return {"table": table, "states": states, "quoted": quoted, "at": {x: k for k, x in enumerate(SYMBOLS)}}


def _clause(state: dict, weight: float, sums: list[float]) -> None:
    """Final weights: a clause counts by the sum of its arcs' weights, for each thing that its state tells."""
    threat = state["threat"] == 2 and state["target"] == 1
    if not (state["insult"] or threat):
        return
    total = weight + (2.0 if threat else 0.0)
    sums[0] += total
    sums[1] += total * state["target"]
    sums[2] += total * (state["negation"] == 2)
    sums[3] += total * (state["report"] > 2)
    sums[4] += 2.0 if threat else 0.0


def _tokens():
    import re

    return re.compile(rf"[^\W_]+(?:['’][^\W_]+)*|[{QUOTES}{BREAKS}]|[{STOPS}]")


def lexicon_weight(word: str, lexicon: dict[str, float]) -> float:
    """The greatest weight of the word's entries: itself ("=word") or one of its stems."""
    best = lexicon.get("=" + word, 0.0)
    for k in range(STEM[0], min(STEM[1], len(word)) + 1):
        best = max(best, lexicon.get(word[:k], 0.0))
    return best


def read_sentence(tokens, lexicon: dict, grammar: dict, state: int, sums: list[float]) -> None:
    """Run the composed grammar over a sentence's tokens; clauses are scored where they end."""
    table, states, at = grammar["table"], grammar["states"], grammar["at"]
    weight = 0.0
    for token in tokens:
        if token in BREAKS or token in STOPS:
            _clause(states[state], weight, sums)
            state, weight = table[state][at["break" if token in BREAKS else "stop"]], 0.0
            continue
        if token in QUOTES:
            state = table[state][at["quote"]]
            continue
        w = lexicon_weight(token, lexicon)
        if w > 0:
            weight += w
            state = table[state][at["insult"]]
        for words, symbol in ((THREATS, "threat"), (PLANS, "plan"), (TARGETS, "target"), (NEGATIONS, "negation"), (REPORTS, "report")):
            if token in words:
                state = table[state][at[symbol]]
    _clause(states[state], weight, sums)


def finder(lexicon: dict):
    """Aho-Corasick automaton over the lexicon and the violent verbs: the grammar can only match sentences
    in which it stops. None without entries."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for entry in [*lexicon, *("=" + w for w in THREATS)]:
        found.add_word(entry.removeprefix("="), True)
    found.make_automaton()
    return found


def text_sums(text: str, lexicon: dict, tools) -> tuple:
    """SUMS of a whole text, each as log(1 + sum), and log(1 + code points)."""
    import math

    grammar, tokens, found, stop = tools
    low = text.lower()
    sums, done, quotes, counted = [0.0] * len(SUMS), 0, 0, 0
    for end, _ in found.iter(low):
        if end < done:
            continue
        start = max([0, *(low.rfind(c, done, end) + 1 for c in STOPS)], default=0)
        start = max(start, done)
        last = stop.search(low, end + 1)
        done = last.start() + 1 if last else len(low)
        quotes += sum(low.count(c, counted, start) for c in QUOTES)
        counted = start
        read_sentence(tokens.findall(low[start:done]), lexicon, grammar, grammar["quoted"] if quotes % 2 else 0, sums)
    return (*(math.log1p(x) for x in sums), math.log1p(len(text)))


def _tools(lexicon: dict):
    import re

    return _grammar(), _tokens(), finder(lexicon), re.compile(f"[{STOPS}]")


def _measured(docs: DataFrame, lexicons, of: str):
    """mapInPandas: (_i, _t, fold) -> (_i, the sums of the text, by the lexicon of its ``of``)."""
    names = [*SUMS, "size"]

    def run(batches, lexicons=lexicons):
        import pandas as pd

        tools = {}
        for part in batches:
            rows = []
            for k, text in zip(part[of], part["_t"], strict=True):
                k = int(k)
                if k not in tools:
                    tools[k] = _tools(lexicons[k])
                rows.append(text_sums(text, lexicons[k], tools[k]))
            out = pd.DataFrame(rows, columns=names)
            out["_i"], out["_y"] = part["_i"].to_numpy(), part["_y"].to_numpy()
            yield out

    return docs.mapInPandas(run, ", ".join(f"{n} double" for n in names) + ", _i long, _y int")


def fold_of(id_):
    return F.crc32(F.encode(id_.cast("string"), "UTF-8")) % FOLDS


def entries(text):
    """Distinct lexicon entries of a text: its words, marked "=", and their stems."""
    words = F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    stems = [F.transform(F.filter(words, lambda w, k=k: F.char_length(w) >= k), lambda w, k=k: F.substring(w, 1, k)) for k in range(STEM[0], STEM[1] + 1)]
    return F.array_union(F.transform(words, lambda w: F.concat(F.lit("="), w)), F.array_distinct(F.concat(*stems)))


def learn_lexicons(sample: DataFrame) -> dict[int, dict[str, float]]:
    """(_i, _t, _y, fold) -> lexicons by fold, each from the rows of the other folds; number 0 from all.

    An entry's weight is its log odds ratio, less SURE standard errors; it must be above 1, the entry occur
    in LEAST toxic texts, and chance be too small for any of all entries to occur like that. The sample is
    bounded and so are its entries; texts are counted, not occurrences."""
    import math

    folds = range(1, FOLDS)
    counts = sample.select("_y", "fold", F.explode(entries(F.col("_t"))).alias("entry")).groupBy("entry").agg(
        *[F.count_if((F.col("_y") == y) & (F.col("fold") == f)).alias(f"n{y}_{f}") for y in (0, 1) for f in folds])
    rate = sample.groupBy("_y", "fold").count().collect()
    total = {(y, f): sum(r["count"] for r in rate if r["_y"] == y and r["fold"] == f) for y in (0, 1) for f in folds}
    toxic = sum(F.col(f"n1_{f}") for f in folds)
    clean = sum(F.col(f"n0_{f}") for f in folds)
    n1, n0 = (sum(v for (y, _), v in total.items() if y == k) for k in (1, 0))
    if not n1 or not n0:
        return {f: {} for f in range(FOLDS)}
    rows = counts.where((toxic >= LEAST) & (toxic * n0 > clean * n1)).collect()  # of a bounded sample
    out = {}
    for left in range(FOLDS):
        use = [f for f in folds if f != left]
        t1, t0 = (sum(total[y, f] for f in use) for y in (1, 0))
        seen = [(r["entry"], sum(r[f"n1_{f}"] for f in use), sum(r[f"n0_{f}"] for f in use)) for r in rows]
        seen = [x for x in seen if x[1] >= LEAST]
        p, lex = t1 / max(1, t1 + t0), {}
        for entry, a, b in seen:
            share = a / (a + b)
            odd = (a + b) * (share * math.log(share / p) + ((1 - share) * math.log((1 - share) / (1 - p)) if b else 0.0)) if 0 < p < share else 0.0
            lo = math.log((a + 0.5) / (t1 + 1)) - math.log((b + 0.5) / (t0 + 1)) - SURE * (1 / (a + 0.5) + 1 / (b + 0.5) / max(1.0, a)) ** 0.5
            if odd > math.log(max(2, len(seen))) and lo > 1:
                lex[entry] = round(lo, 4)
        out[left] = lex
    return out


def fit_weights(x, y, ridge: float = 2.0):
    """Logistic regression by Newton steps, drawn to PRIOR by the ridge -> (weights of SUMS and size, intercept)."""
    import numpy as np

    x = np.c_[x, np.ones(len(x))]
    prior = np.r_[PRIOR, 0.0, BASE]
    w, keep = prior.copy(), ridge * np.r_[np.ones(len(prior) - 1), 0.05]
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(keep), x.T @ (y - p) - keep * (w - prior))
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1].tolist(), float(w[-1])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          labelled: int = LABELLED) -> dict:
    """Lexicon and weights from the ``labelled`` labelled rows of smallest hash outside fold 0. The weights
    are fitted on sums that each row gets from a lexicon learned without its own fold."""
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("_i")).agg(
        (F.avg(label_col) >= 0.5).cast("int").alias("_y")).withColumn("fold", fold_of(F.col("_i"))).where("fold <> 0")
    texts = docs.select(docs[f"`{id_col}`"].cast("long").alias("_i"), F.coalesce(docs[f"`{text_col}`"].cast("string"), F.lit("")).alias("_t"))
    marks = marks.join(texts.select("_i").distinct(), "_i", "left_semi").orderBy(F.xxhash64("_i"), "_i").limit(labelled)
    from verba.llm.common import written

    sample = written(texts.join(F.broadcast(marks), "_i"), "labelled")  # ``labelled`` ids at most
    lexicons = learn_lexicons(sample)
    weights, base = list(PRIOR) + [0.0], BASE
    got = _measured(sample, lexicons, "fold").toPandas()  # a few numbers for each row of the sample
    if lexicons[0] and got["_y"].nunique() == 2:
        weights, base = fit_weights(got[[*SUMS, "size"]].to_numpy(), got["_y"].to_numpy(dtype=float))
    return {"lexicon": lexicons[0], "weights": weights, "base": base}


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
                   model: dict | None = None, labelled: int = LABELLED) -> DataFrame:
    """One row per row of ``docs``: id, held_out (its label is never learned from), score, predicted (score of
    at least 0.5), clauses' insult weight as ``insults``.

    A sentence in which the lexicon or a violent verb occurs is read by the composed grammar; each clause
    that it matches adds its weight, apart for those aimed at somebody, denied, told of and threatening.
    The score reads the text alone. Whole texts are read; null is empty. Null ids have no label and aren't held
    out; ids may repeat, each row is scored by itself. Labels with a null id or value are left out, several
    of one id are averaged. Without labels of both kinds the lexicon is empty: threats alone score, by the
    grammar's own weights. Empty table: no rows."""
    model = model or train(docs, labels, id_col, text_col, label_col, labelled)
    lexicon, weights, base = model["lexicon"], model["weights"], model["base"]
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("array<double>")
    def measure(texts):
        import math

        import pandas as pd

        tools = _tools(lexicon)
        out = []
        for text in texts:
            sums = text_sums(text, lexicon, tools)
            z = base + sum(w * x for w, x in zip(weights, sums, strict=True))
            out.append([1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), math.expm1(sums[0])])
        return pd.Series(out)

    col = docs[f"`{id_col}`"]
    out = docs.select(col.alias(id_col), F.coalesce(fold_of(col) == 0, F.lit(False)).alias("held_out"),
                      measure.asNondeterministic()(F.coalesce(docs[f"`{text_col}`"].cast("string"), F.lit(""))).alias("_m"))
    return out.select(id_col, "held_out", F.col("_m")[0].alias("score"), (F.col("_m")[0] >= 0.5).cast("int").alias("predicted"),
                      F.col("_m")[1].alias("insults"))
