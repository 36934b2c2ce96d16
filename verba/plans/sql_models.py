"""DuckDB spellings of model training and scoring, used only to write oracle SQL.

The oracle uses the long form (id, class, value) and window softmax; the Spark
plans use dense arrays. Agreement of the two is the correctness check.
"""

from __future__ import annotations

from verba.operators import language as L
from verba.operators import registry as M
from verba.plans import sql_text as S


def pdt(e: str) -> str:
    """LNG4 detector text."""
    c = S.rr(e, S.T.NOT_WORD_NOT_SPACE, " ")
    c = S.rr(c, S.T.DIGITS, "")
    return S.collapse_ws(c)


def rdt(e: str) -> str:
    """LNG3 detector text."""
    c = S.collapse_ws(e)
    c = S.rr(c, S.T.URL, "")
    c = S.rr(S.rr(c, S.T.MENTION, ""), S.T.HASHTAG, "")
    return strip_ws(c)


def strip_ws(e: str) -> str:
    w = S.T.WS_CLASS
    return S.rr(e, "^" + w + "+|" + w + "+$", "")


def detector_grams(e: str) -> str:
    return S.char_ngrams(f"(' ' || lower({e}) || ' ')", 3)


def model_text(e: str, truncate: bool = True) -> str:
    return S.normalize_text(S.clean_text(e), truncate)


def feats(kind: str, e: str) -> str:
    return S.word_tokens(e) if kind == "word" else S.char_ngrams(e, 3)


def values(rows, cols) -> str:
    body = ", ".join("(" + ", ".join(S.q(v) if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) v({', '.join(cols)}))"


# ---------------------------------------------------------------- language model

def lang_model_ctes(p: str = "lm") -> list:
    return [
        f"{p}_src AS MATERIALIZED (SELECT lang, {pdt(S.clean_text('text'))} AS t FROM documents "
        f"WHERE lang IS NOT NULL)",
        f"{p}_cls AS (SELECT lang, count(*) AS n, row_number() OVER (ORDER BY lang) AS k FROM {p}_src GROUP BY lang)",
        f"{p}_prior AS (SELECT lang, k, ln((n + 1) / ((SELECT sum(n) FROM {p}_cls) + (SELECT count(*) FROM {p}_cls))) AS lp "
        f"FROM {p}_cls)",
        f"{p}_pad AS MATERIALIZED (SELECT lang, ' ' || lower(t) || ' ' AS pt FROM {p}_src)",
        f"{p}_ex AS (SELECT lang, unnest({S.char_ngrams('pt', 3)}) AS g FROM {p}_pad)",
        f"{p}_cnt AS (SELECT g, lang, count(*) AS c FROM {p}_ex GROUP BY g, lang)",
        f"{p}_voc AS (SELECT DISTINCT g FROM {p}_cnt)",
        f"{p}_tot AS (SELECT lang, sum(c) AS tot FROM {p}_cnt GROUP BY lang)",
        f"{p}_w AS (SELECT v.g, pr.lang, pr.k, ln((coalesce(c.c, 0) + 1) / (t.tot + (SELECT count(*) FROM {p}_voc))) AS w "
        f"FROM {p}_voc v CROSS JOIN {p}_prior pr JOIN {p}_tot t ON t.lang = pr.lang "
        f"LEFT JOIN {p}_cnt c ON c.g = v.g AND c.lang = pr.lang)",
    ]


def lang_score_ctes(src: str, out: str, p: str = "lm") -> list:
    """src: CTE with (id, dt); out: CTE with (id, detected, n_grams); detected null when no grams hit."""
    return [
        f"{out}_pad AS MATERIALIZED (SELECT id, ' ' || lower(dt) || ' ' AS pt FROM {src})",
        f"{out}_ex AS (SELECT id, unnest({S.char_ngrams('pt', 3)}) AS g FROM {out}_pad)",
        f"{out}_agg AS (SELECT e.id, w.lang, sum(w.w) AS s, count(*) AS n FROM {out}_ex e JOIN {p}_w w ON w.g = e.g "
        f"GROUP BY e.id, w.lang)",
        f"{out}_sc AS (SELECT d.id, pr.lang, pr.lp + coalesce(a.s, 0) AS score, coalesce(a.n, 0) AS n, "
        f"row_number() OVER (PARTITION BY d.id ORDER BY pr.lp + coalesce(a.s, 0) DESC, pr.k) AS rk "
        f"FROM {src} d CROSS JOIN {p}_prior pr LEFT JOIN {out}_agg a ON a.id = d.id AND a.lang = pr.lang)",
        f"{out} AS (SELECT id, CASE WHEN n > 0 THEN lang END AS detected, n AS n_grams FROM {out}_sc WHERE rk = 1)",
    ]


def lang_code_map(e: str) -> str:
    m = " ".join(f"WHEN {S.q(k)} THEN {S.q(v)}" for k, v in L.LANGUAGE_CODE_MAP.items())
    return f"(CASE {e} {m} ELSE {e} END)"


# ---------------------------------------------------------------- naive Bayes

def corpus_sql(task: str) -> str:
    if task == "spam":
        lab = "CASE WHEN l.quality = 0 THEN 'LABEL_1' ELSE 'LABEL_0' END"
    else:
        lab = "CASE WHEN l.toxic = 1 THEN 'Negative' ELSE 'Positive' END"
    return f"SELECT d.doc_id, {lab} AS label, d.text FROM labels l JOIN documents d ON d.doc_id = l.doc_id"


def nb_train_ctes(task: str, kind: str, p: str) -> list:
    classes = M.TASK_CLASSES[task]
    cls_rows = [(c, i + 1, M.output_label(task, c)) for i, c in enumerate(classes)]
    return [
        f"{p}_corpus AS MATERIALIZED (SELECT doc_id, label, {model_text('text', False)} AS t FROM ({corpus_sql(task)}) c0)",
        f"{p}_cls AS {values(cls_rows, ['label', 'k', 'out_label'])}",
        f"{p}_prior AS (SELECT c.label, c.k, c.out_label, ln((count(x.label) + 1) / "
        f"((SELECT count(*) FROM {p}_corpus) + {len(classes)})) AS lp "
        f"FROM {p}_cls c LEFT JOIN {p}_corpus x ON x.label = c.label GROUP BY c.label, c.k, c.out_label)",
        f"{p}_ex AS (SELECT label, unnest({feats(kind, 't')}) AS f FROM {p}_corpus)",
        f"{p}_cnt AS (SELECT f, label, count(*) AS c FROM {p}_ex GROUP BY f, label)",
        f"{p}_voc AS (SELECT DISTINCT f FROM {p}_cnt)",
        f"{p}_tot AS (SELECT c.label, coalesce(sum(n.c), 0) AS tot FROM {p}_cls c LEFT JOIN {p}_cnt n ON n.label = c.label "
        f"GROUP BY c.label)",
        f"{p}_w AS (SELECT v.f, pr.label, pr.k, pr.out_label, "
        f"ln((coalesce(n.c, 0) + 1) / (t.tot + (SELECT count(*) FROM {p}_voc))) AS w "
        f"FROM {p}_voc v CROSS JOIN {p}_prior pr JOIN {p}_tot t ON t.label = pr.label "
        f"LEFT JOIN {p}_cnt n ON n.f = v.f AND n.label = pr.label)",
    ]


def nb_score_ctes(kind: str, p: str, src: str, out: str, temperature: str = "1.0") -> list:
    """src: CTE with (id, t) model text; out: CTE (id, label, k, out_label, prob, score) where
    prob is the model softmax and score the temperature-rescaled probability."""
    return [
        f"{out}_ex AS (SELECT id, unnest({feats(kind, 't')}) AS f FROM {src})",
        f"{out}_agg AS (SELECT e.id, w.label, sum(w.w) AS s, count(*) AS n FROM {out}_ex e JOIN {p}_w w ON w.f = e.f "
        f"GROUP BY e.id, w.label)",
        f"{out}_lg AS (SELECT d.id, pr.label, pr.k, pr.out_label, pr.lp + CASE WHEN coalesce(a.n, 0) > 0 "
        f"THEN a.s / a.n ELSE 0 END AS logit FROM {src} d CROSS JOIN {p}_prior pr "
        f"LEFT JOIN {out}_agg a ON a.id = d.id AND a.label = pr.label)",
        *softmax_ctes(f"{out}_lg", f"{out}_pr", ["id", "label", "k", "out_label"], "logit", "prob", "id"),
        *rescale_ctes(f"{out}_pr", out, temperature, ["id", "label", "k", "out_label", "prob"]),
    ]


def rescale_ctes(src: str, out: str, temperature: str, cols: list, prob: str = "prob") -> list:
    """MDL9 in long form: clip, log, /T, softmax per id."""
    t = f"(CASE WHEN {temperature} <= 0 THEN 1.0 ELSE {temperature} END)"
    keep = ", ".join(cols)
    return [
        f"{out}_l AS (SELECT {keep}, ln(greatest(1e-8, least(1 - 1e-8, {prob}))) / {t} AS z FROM {src})",
        *softmax_ctes(f"{out}_l", out, cols, "z", "score", "id"),
    ]


def softmax_ctes(src: str, out: str, cols: list, val: str, name: str, part: str) -> list:
    """Max-subtracted softmax of ``val`` per ``part`` in long form (two CTEs: no nested windows)."""
    keep = ", ".join(cols)
    return [
        f"{out}_m AS (SELECT {keep}, exp({val} - max({val}) OVER (PARTITION BY {part})) AS e FROM {src})",
        f"{out} AS (SELECT {keep}, e / sum(e) OVER (PARTITION BY {part}) AS {name} FROM {out}_m)",
    ]


def with_(ctes: list, select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select
