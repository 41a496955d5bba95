"""SQL for the workload tables, to check the Spark jobs against another engine."""

from __future__ import annotations

from plumbline.operators.pairing import POISSON_CUTS


def U(*parts: str) -> str:
    """SQL of the hash-derived uniform over the given SQL expressions."""
    return f"(('0x'||substr(md5(concat_ws('|',{','.join(parts)})),1,8))::BIGINT/4294967296.0::DOUBLE)"


TASK = (
    "CASE substr(o_orderpriority,1,1) WHEN '1' THEN 'math_word_problem' WHEN '2' THEN 'multiple_choice' "
    "WHEN '3' THEN 'summarization' WHEN '4' THEN 'long_form_qa' ELSE 'support_reply' END")


def split(key: str) -> str:
    u = U("'split'", key)
    return f"CASE WHEN {u}<0.2 THEN 'calibration' WHEN {u}<0.5 THEN 'dev' ELSE 'test' END"


def model(eid: str) -> str:
    return f"CASE WHEN {eid}%3=0 THEN 'm-small' WHEN {eid}%3=1 THEN 'm-mid' ELSE 'm-large' END"


FIXED = "CAST(floor(x::DOUBLE*16777216.0+0.5) AS BIGINT)"


def fixed(vec: str) -> str:
    return f"list_transform({vec}, lambda x: {FIXED})"


def dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a},{b}), lambda z: z[1]*z[2]))"


CTES: dict[str, str] = {}
CTES["catalog"] = """SELECT * FROM (VALUES
  ('m-small','alpha','cheap',75::BIGINT,300::BIGINT,NULL::BIGINT,NULL::BIGINT,32768,true),
  ('m-mid','beta','mid',1000,5000,100,1250,64000,true),
  ('m-large','beta','strong',5000,25000,500,6250,128000,false))
  t(model,provider,rung,input_nano,output_nano,cache_read_nano,cache_write_nano,max_output_tokens,supports_sampling_params)"""
CTES["ladder"] = """SELECT * FROM (VALUES ('m-small',0,0.62::DOUBLE,75::BIGINT,300::BIGINT),
  ('m-mid',1,0.82,1000,5000),('m-large',2,0.90,5000,25000)) t(model,rung,p,p_in,p_out)"""
CTES["items"] = f"""SELECT 'item-'||o_orderkey AS slug, o_orderkey AS key, {TASK} AS task_type, {split('o_orderkey')} AS split,
  CASE {TASK} WHEN 'math_word_problem' THEN o_orderkey::VARCHAR WHEN 'multiple_choice' THEN chr((65+o_orderkey%10)::INT) END AS ground_truth,
  CASE {TASK} WHEN 'math_word_problem' THEN 'final_number' WHEN 'multiple_choice' THEN 'choice_letter' END AS verifier,
  substr(o_orderpriority,1,1) IN ('1','2') AS verifiable,
  'Order '||o_orderkey||' of customer '||o_custkey||' totals '||o_orderstatus AS prompt,
  40+o_orderkey%900 AS prompt_chars FROM orders"""
CTES["records"] = f"""SELECT 'item-'||o_orderkey AS slug, {TASK} AS task_type, {split('o_orderkey')} AS split, l.model, l.rung,
  ({U("'ok'", 'o_orderkey')}<l.p OR {U("'ok'", 'o_orderkey', 'l.model')}<l.p/4) AS success,
  (100+o_orderkey%900)*p_in+(200+o_custkey%400)*p_out AS cost_nano,
  (floor({U("'agree'", 'o_orderkey')}*5)+1)/5 AS agreement,
  floor({U("'check'", 'o_orderkey')}*101)/100 AS verifier_confidence FROM orders, ladder l"""
CTES["pilot"] = "SELECT slug, model, success AS passed, task_type FROM records"
_RIGHT = f"{U(chr(39)+'gen'+chr(39), 'key', 'model', 'idx')}<p"
CTES["generations"] = f"""SELECT 'item-'||key AS slug, model, idx AS replicate_idx, CASE WHEN key%2=0 THEN
    CASE form WHEN 0 THEN 'Work: 3*4=12.'||chr(10)||'#### '||num WHEN 1 THEN 'The answer is '||num||'.00' WHEN 2 THEN 'so therefore '||num
      WHEN 3 THEN 'I cannot solve this.' ELSE '#### $'||num END
    ELSE CASE form WHEN 0 THEN 'The answer is ('||let||')' WHEN 1 THEN 'Answer: '||let||', worth '||num WHEN 2 THEN '#### '||let
      WHEN 3 THEN 'thinking'||chr(10)||let ELSE chr(92)||'boxed{{'||num||'}}' END END AS text,
  100+key%900 AS input_tokens, 50+(key*7+idx)%400 AS output_tokens FROM (
  SELECT *, (CASE WHEN good THEN key ELSE key+1 END)::VARCHAR AS num, chr((65+(key+CASE WHEN good THEN 0 ELSE 1 END)%10)::INT) AS let FROM (
  SELECT *, {_RIGHT} AS good, (key+idx)%5 AS form FROM (
  SELECT l_orderkey AS key, l_linenumber-1 AS idx, l.model, l.p FROM lineitem, ladder l) WHERE NOT (model='m-large' AND key%17=0)))"""
_RUN = U("'run'", "slug", "model", "replicate_idx")
CTES["outcomes"] = f"""SELECT slug, model, task_type, CASE WHEN u<0.02 THEN 'timeout' WHEN u<0.03 THEN 'rate_limited' WHEN u<0.04 THEN 'provider_5xx' END AS error_kind,
  u>0.8 AS from_cache, key%10<>0 AS usage_is_final, input_tokens, output_tokens, input_tokens*75+output_tokens*300 AS cost_nano,
  floor(u*4000)::BIGINT AS latency_ms, CASE WHEN verifier IS NOT NULL THEN (key+replicate_idx)%3>0 END AS passed
  FROM (SELECT g.*, i.key, i.task_type, i.verifier, {_RUN.replace('slug', 'g.slug')} AS u FROM generations g JOIN items i USING (slug))"""
_K = "(props::JSON->>'$.k')::BIGINT"
_COST = f"CASE WHEN event_id%3=0 THEN {_K}*75+floor(value)::BIGINT*300 WHEN event_id%3=1 THEN {_K}*1000+floor(value)::BIGINT*5000 ELSE {_K}*5000+floor(value)::BIGINT*25000 END"
_BODY = f"""'{{"messages":[{{"role":"user","content":"'||event_type||' '||{_K}||'"}}]}}'"""
CTES["traces"] = f"""SELECT event_id AS id, 'req-'||(event_id-event_id%2) AS request_id, ts AS created_at, event_type AS route_key, {model('event_id')} AS model_served,
  CASE WHEN event_id%3=0 THEN 'alpha' ELSE 'beta' END AS provider, CASE WHEN event_type='error' THEN 500 ELSE 200 END AS status,
  CASE WHEN event_type='error' THEN 'provider_5xx' END AS error_kind, {_K} AS input_tokens, floor(value)::BIGINT AS output_tokens,
  (floor(value*10)+50)::BIGINT AS latency_ms, ((floor(value*10)+50)::BIGINT)//4 AS ttft_ms, event_id%10<>0 AS usage_is_final, {_COST} AS cost_nano,
  length(props)*100+event_id%700 AS bytes, 1 AS policy_version, {_BODY} AS request_body,
  CASE event_id%4 WHEN 0 THEN '{{"choices":[{{"message":{{"content":"r'||{_K}||'"}}}}]}}' WHEN 1 THEN '{{}}' ELSE '{{"text":"r'||{_K}||'"}}' END AS response_body,
  sha256({_BODY}) AS request_hash,
  CASE WHEN event_id%11=0 THEN NULL ELSE (event_type='error' OR value>60.0) END AS counts FROM events"""
CTES["event_log"] = f"""SELECT request_id, seq, kind, seen_at, model, input_tokens, output_tokens, delta FROM (
  SELECT event_id AS request_id, s.seq, s.kind, ts + to_seconds(s.seq) AS seen_at, {model('event_id')} AS model,
    CASE WHEN s.seq=0 THEN {_K} END AS input_tokens,
    CASE s.seq WHEN 0 THEN 1 WHEN 2 THEN floor(floor(value)/2)::BIGINT WHEN 5 THEN floor(value)::BIGINT END AS output_tokens,
    CASE s.seq WHEN 1 THEN event_type WHEN 3 THEN '-'||{_K} WHEN 4 THEN 'hm' END AS delta
  FROM events, (VALUES (0,'start'),(1,'text'),(2,'usage'),(3,'text'),(4,'thinking'),(5,'finish')) s(seq,kind))
  WHERE NOT (request_id%13=0 AND seq>=3)"""
CTES["assembled"] = """SELECT request_id, max(model) AS model, coalesce(max_by(input_tokens,seq) FILTER (input_tokens IS NOT NULL),0)::BIGINT AS input_tokens,
  coalesce(max_by(output_tokens,seq) FILTER (output_tokens IS NOT NULL),0)::BIGINT AS output_tokens,
  coalesce(string_agg(delta,'' ORDER BY seq) FILTER (kind='text'),'') AS text, coalesce(sum(length(delta)) FILTER (kind='thinking'),0)::BIGINT AS thinking_chars,
  count(*) AS events, min(seen_at) AS created_at, (epoch_us(max(seen_at))//1000 - epoch_us(min(seen_at))//1000) AS latency_ms,
  (epoch_us(min(seen_at) FILTER (kind='text'))//1000 - epoch_us(min(seen_at))//1000) AS ttft_ms, bool_or(kind='finish') AS usage_is_final,
  CASE WHEN bool_or(kind='finish') THEN 'stop' ELSE 'length' END AS finish_reason, CASE WHEN NOT bool_or(kind='finish') THEN 'stream_abort' END AS error_kind
  FROM event_log GROUP BY request_id"""
CTES["labelled"] = f"""SELECT d.doc_id, 'doc-'||d.doc_id AS pair_id, lang AS task_type, CASE WHEN quality=1 AND toxic=0 THEN 'win' WHEN quality=1 THEN 'tie' ELSE 'loss' END AS human,
  n_chars*7%20000 AS elapsed_ms, n_chars, CASE WHEN {U("'shown'", 'd.doc_id')}<0.5 THEN 'A' ELSE 'B' END AS candidate_shown_as
  FROM documents d JOIN labels l USING (doc_id)"""
CTES["judgments"] = f"""SELECT pair_id, CASE WHEN {U("'parse'", 'doc_id')}>=0.05 THEN CASE WHEN {U("'j'", 'doc_id')}<0.75 THEN human WHEN n_chars%3=0 THEN 'win' WHEN n_chars%3=1 THEN 'tie' ELSE 'loss' END END AS outcome,
  {U("'parse'", 'doc_id')}<0.05 AS unparseable, {U("'flip'", 'doc_id')}<0.1 AS position_flip FROM labelled WHERE {U("'miss'", 'doc_id')}>=0.03"""
CTES["joined"] = """SELECT l.*, j.outcome, j.unparseable, j.position_flip, CASE WHEN j.pair_id IS NULL THEN 'missing' WHEN j.unparseable OR j.outcome IS NULL THEN 'unparseable' ELSE 'compared' END AS status
  FROM labelled l LEFT JOIN judgments j USING (pair_id)"""
_REPLY = U("'reply'", "doc_id", "position")
CTES["replies"] = f"""SELECT 'doc-'||doc_id AS pair_id, position, CASE WHEN form=0 THEN plain WHEN form=1 THEN '```json'||chr(10)||plain||chr(10)||'```' WHEN form=2 THEN 'My view: '||plain||' as said.'
    WHEN form=3 THEN bare WHEN form=4 THEN '```'||chr(10)||bare||chr(10)||'```' WHEN form=5 AND doc_id%3=0 THEN '{{"outcome": "C", "confidence": 0.9}}'
    WHEN form=6 AND doc_id%3=0 THEN '{{"outcome": "'||mark||'", "confidence": 5}}' WHEN form=7 AND doc_id%3=0 THEN '' ELSE plain END AS raw FROM (
  SELECT *, '{{"outcome": "'||mark||'", "confidence": '||(floor(u*100)/100)::VARCHAR||'}}' AS plain, '{{"outcome": "'||mark||'"}}' AS bare FROM (
  SELECT *, CASE WHEN u<0.4 THEN 'A' WHEN u<0.8 THEN 'B' ELSE 'tie' END AS mark, (doc_id+CASE WHEN position='A' THEN 0 ELSE 1 END)%8 AS form FROM (
  SELECT doc_id, position, {_REPLY} AS u FROM documents, (VALUES ('A'),('B')) p(position))))"""
CTES["raw_items"] = "SELECT source AS source_dataset, doc_id::VARCHAR AS source_id, lang AS task_type, text, doc_id FROM documents"
CTES["vectors"] = "SELECT vec_id AS slug, embedding AS vec, label FROM embeddings"
CTES["reworded"] = """SELECT a.slug, list_transform(list_zip(a.vec,b.vec), lambda z: (z[1]::DOUBLE + ((a.slug%21)/10.0::DOUBLE)*z[2]::DOUBLE)::FLOAT) AS vec
  FROM (SELECT *, CASE WHEN slug=max(slug) OVER () THEN min(slug) OVER () ELSE slug+1 END AS after FROM vectors) a JOIN vectors b ON b.slug=a.after"""
CTES["requests"] = f"""SELECT event_id AS request_id, CASE WHEN event_id%4=0 THEN 'm-small' ELSE 'auto' END AS model,
  CASE event_id%5 WHEN 0 THEN '  ' WHEN 1 THEN ' '||event_type||' ' WHEN 2 THEN 'elsewhere' WHEN 3 THEN event_type END AS route_hint,
  CASE event_id%7 WHEN 0 THEN ' OFF ' WHEN 1 THEN 'bogus' WHEN 2 THEN 'offline' END AS mode_header,
  CASE WHEN k%3=0 THEN k/40.0::DOUBLE END AS temperature, CASE WHEN k%4=0 THEN k/90.0::DOUBLE END AS top_p, CASE WHEN k%5=0 THEN k-10 END AS max_tokens,
  CASE WHEN k%6=0 THEN k*1000 END AS max_completion_tokens, CASE WHEN k%7=0 THEN k%3 END AS n, CASE WHEN k%8=0 THEN k%6+1 END AS stops,
  CASE WHEN event_id%29=0 THEN 'system' ELSE 'user' END AS role, event_id%2=0 AS pinned, {model('event_id')} AS target
  FROM (SELECT *, {_K} AS k FROM events)"""

NEEDS = {
    "records": ["ladder"], "pilot": ["records"], "generations": ["ladder"], "outcomes": ["generations", "items"],
    "assembled": ["event_log"], "judgments": ["labelled"], "joined": ["judgments"], "reworded": ["vectors"],
}


def query(body: str, *ctes: str, **extra: str) -> str:
    """A WITH query: named workload tables in order of need, then extra ones, then the body."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, []):
            add(need)
        if name not in order:
            order.append(name)

    for name in ctes:
        add(name)
    named = [(n, CTES[n]) for n in order] + list(extra.items())
    # Derived once each, however often later parts read them.
    parts = [f"{n} AS {'' if '/*recursive*/' in sql else 'MATERIALIZED '}({sql})" for n, sql in named]
    recursive = "RECURSIVE " if any("/*recursive*/" in p for p in parts) else ""
    return (f"WITH {recursive}" + ",\n".join(parts) + "\n" if parts else "") + body


def interval_ctes(counts: str, keys: list[str], alpha: float = 0.05, resamples: int = 10000) -> dict[str, str]:
    """CTEs giving ``bounds(keys, low, high)`` for a CTE with integer n, b, c per key.

    The distribution of b' - c' under resampling, summed from multinomial probabilities. The
    enumeration spans 12 standard deviations and more on both sides.
    """
    k = ", ".join(keys)
    lo = int((alpha / 2) * resamples) / resamples
    hi = min(resamples - 1, int((1 - alpha / 2) * resamples)) / resamples
    reach = lambda x: f"range(greatest(0, floor({x}-12*sqrt({x})-40)::BIGINT), least(n, ceil({x}+12*sqrt({x})+40)::BIGINT)+1)"
    return {
        "spread": f"SELECT {k}, n, b, c, unnest({reach('b')}) AS x1 FROM {counts} WHERE n>0",
        "spread2": f"SELECT {k}, n, b, c, x1, unnest({reach('c')}) AS x2 FROM spread",
        "masses": f"""SELECT {k}, x1-x2 AS d, sum(exp(lgamma(n+1)-lgamma(x1+1)-lgamma(x2+1)-lgamma(n-x1-x2+1)
            +CASE WHEN b>0 THEN x1*ln(b/n::DOUBLE) ELSE 0 END+CASE WHEN c>0 THEN x2*ln(c/n::DOUBLE) ELSE 0 END
            +CASE WHEN n-b-c>0 THEN (n-x1-x2)*ln((n-b-c)/n::DOUBLE) ELSE 0 END)) AS p
            FROM spread2 WHERE x1+x2<=n AND (b>0 OR x1=0) AND (c>0 OR x2=0) AND (n-b-c>0 OR x1+x2=n) GROUP BY ALL""",
        "cdf": f"SELECT {k}, d, sum(p) OVER (PARTITION BY {k} ORDER BY d) AS f FROM masses",
        "bounds": f"SELECT {k}, (min(d) FILTER (f>{lo}))::BIGINT AS low, (min(d) FILTER (f>{hi}))::BIGINT AS high FROM cdf GROUP BY {k}",
    }


def exact_p(b: str, c: str) -> str:
    n = f"({b}+{c})"
    ways = f"factorial({n}::INT)/(factorial(i::INT)*factorial(({n}-i)::INT))"
    return (f"CASE WHEN {n}=0 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, 2.0::DOUBLE*list_sum(list_transform("
            f"range(0, least({b},{c})+1), lambda i: ({ways})::DOUBLE))/pow(2.0::DOUBLE,{n})) END")


def erfc(z: str) -> str:
    """Simpson's rule over [z, z+12] with 6000 steps."""
    h = "(12.0::DOUBLE/6000)"
    node = f"exp(-(({z})+i*{h})*(({z})+i*{h}))*CASE WHEN i=0 OR i=6000 THEN 1 WHEN i%2=1 THEN 4 ELSE 2 END"
    return f"(2.0/sqrt(pi())*{h}/3*list_sum(list_transform(range(0,6001), lambda i: {node})))"


def mcnemar_p(b: str, c: str) -> str:
    """p by the count of discordant pairs; the exact branch never sees a large factorial."""
    small = f"({b}+{c})<25"
    sb, sc = f"(CASE WHEN {small} THEN {b} ELSE 0 END)", f"(CASE WHEN {small} THEN {c} ELSE 0 END)"
    z = f"sqrt((abs({b}-{c})-1.0)*(abs({b}-{c})-1.0)/({b}+{c})/2.0)"
    return f"round(CASE WHEN {small} THEN {exact_p(sb, sc)} ELSE least(1.0, {erfc(z)}) END, 8)"


def outcome(low: str, high: str, margin: float = 0.03) -> str:
    return (f"CASE WHEN {high}< -{margin} THEN 'REGRESSION' WHEN {low}>{margin} THEN 'IMPROVEMENT' "
            f"WHEN {low}>= -{margin} AND {high}<={margin} THEN 'EQUIVALENT' ELSE 'INCONCLUSIVE' END")


def exact_bound_ctes(counts: str, keys: list[str], alpha: float = 0.05) -> dict[str, str]:
    """``clopper(keys, low, high)`` by bisection of the binomial tail, for integer k, n per key."""
    ks = ", ".join(keys)
    tail = ("list_sum(list_transform(range(0,k+1), lambda i: exp(lgamma(n+1)-lgamma(i+1)-lgamma(n-i+1)"
            "+i*ln((lo+hi)/2)+(n-i)*ln(1-(lo+hi)/2))))")
    both = f"SELECT {ks}, 'high' AS side, k, n FROM {counts} UNION ALL SELECT {ks}, 'low', n-k, n FROM {counts}"
    return {
        "sides": both,
        "bisect": f"""/*recursive*/ SELECT {ks}, side, k, n, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi, 0 AS step FROM sides
            UNION ALL SELECT {ks}, side, k, n, CASE WHEN {tail}>{alpha / 2} THEN (lo+hi)/2 ELSE lo END,
            CASE WHEN {tail}>{alpha / 2} THEN hi ELSE (lo+hi)/2 END, step+1 FROM bisect WHERE step<50 AND k<n""",
        "ends": f"SELECT {ks}, side, k, n, max_by(hi, step) AS p FROM bisect GROUP BY ALL",
        "clopper": f"""SELECT {ks}, round(max(CASE WHEN side='low' THEN CASE WHEN k=n THEN 0.0 ELSE 1-p END END),8) AS low,
            round(max(CASE WHEN side='high' THEN CASE WHEN k=n THEN 1.0 ELSE p END END),8) AS high FROM ends GROUP BY {ks}""",
    }


def poisson(u: str) -> str:
    return "(" + "+".join(f"({u}>={cut})::INT" for cut in POISSON_CUTS) + ")"


def bucket(score: str, grid) -> str:
    return "(" + "+".join(f"({score}>={float(t)!r}::DOUBLE)::INT" for t in grid) + ")"


def grid_values(grid) -> str:
    return "(VALUES " + ",".join(f"({float(t)!r}::DOUBLE,{i})" for i, t in enumerate(grid)) + ") g(threshold,pos)"


CELL_COLUMNS = ", ".join(
    f"count(*) FILTER (human='{h}' AND outcome='{j}') AS {h}_{j}" for h in ("win", "tie", "loss") for j in ("win", "tie", "loss"))
