"""The same results in DuckDB SQL, over the same tables."""

from __future__ import annotations

from checks.pairs_view import PAIRS_SQL

ID = "[a-zA-Z]+:[a-zA-Z]+[0-9]+"
BOUND_ID = rf"\b{ID}\b"
LABEL = r"\bENTITY_[0-9]+\b"

PAIRS = f"pairs AS ({PAIRS_SQL})"

DICTIONARY = f"""{PAIRS},
ids AS (
  SELECT DISTINCT unnest(regexp_extract_all(sparql_wikidata, '{ID}')) AS eid
  FROM pairs WHERE sparql_wikidata IS NOT NULL
),
width AS (SELECT length(cast(count(*) AS varchar))::int AS w FROM ids),
dictionary AS (
  SELECT eid, 'ENTITY_' || lpad(cast(row_number() OVER (ORDER BY eid) AS varchar), w, '0') AS label
  FROM ids, width
  UNION ALL SELECT 'ENTITY_UNK', 'ENTITY_' || repeat('0', w) FROM width
)"""

ENCODED = f"""{DICTIONARY},
pieces AS (
  SELECT row_id, regexp_extract_all(sparql_wikidata, '{BOUND_ID}') AS found,
    string_split_regex(sparql_wikidata, '{BOUND_ID}') AS around
  FROM pairs WHERE sparql_wikidata IS NOT NULL
),
places AS (SELECT row_id, found, around, unnest(range(1, len(found) + 1)) AS i FROM pieces),
swapped AS (
  SELECT row_id, string_agg(around[i] || coalesce(label, found[i]), '' ORDER BY i) AS head
  FROM places LEFT JOIN dictionary ON eid = found[i] GROUP BY row_id
),
encoded AS MATERIALIZED (
  SELECT p.row_id, p.paraphrased_question AS question, p.sparql_wikidata AS sparql,
    coalesce(s.head, '') || around[len(around)] AS sparql_modf
  FROM pairs p LEFT JOIN pieces c ON c.row_id = p.row_id LEFT JOIN swapped s ON s.row_id = p.row_id
)"""

ARROW = "chr(8594)"
HEADER = f"'Question ' || {ARROW} || ' SPARQL:'"


def prompt(question: str, query: str | None = None) -> str:
    def line(lead: str, value: str) -> str:
        return f"CASE WHEN length({value}) > 0 THEN chr(10) || '{lead}: ' || {value} ELSE '' END"

    text = f"{HEADER} || {line('Question', question)}"
    return text if query is None else f"{text} || {line('SPARQL', query)}"


def byte_ids(text: str) -> str:
    return f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::INT)"


def shown(values: str, mark: str = " ") -> str:
    return f"coalesce(array_to_string({values}, '{mark}'), '')"


def byte_texts(ids: str) -> str:
    return f"list_transform({ids}, lambda b: CASE WHEN b < 128 THEN chr(b) ELSE chr(65533) END)"


SPLIT = f"""WITH {PAIRS},
train AS (SELECT * FROM pairs WHERE part = 'train'),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY md5('42:' || row_id), row_id) AS place FROM train
),
size AS (SELECT ceil(count(*) * 0.1::double) AS n FROM train)
SELECT row_id, paraphrased_question AS question, sparql_wikidata AS sparql
FROM ranked, size WHERE place"""

TURNS = f"""turns AS (
  SELECT conv_id, turn, text, {byte_ids('text')} AS ids,
    row_number() OVER (ORDER BY conv_id, turn) - 1 AS ord
  FROM conversations
),
wide AS (
  SELECT *, ord // 8 AS batch_id, max(len(ids) + 1) OVER (PARTITION BY ord // 8) AS w FROM turns
),
padded AS (
  SELECT *, list_concat(ids, list_transform(range(w - len(ids)), lambda x: 50256)) AS p FROM wide
),
collated AS (
  SELECT batch_id, ord, conv_id, turn, p[1:w - 1][1:1024] AS inputs,
    list_transform(p[2:w], lambda v, i:
      CASE WHEN v = 50256 AND i > greatest(len(ids), 1) THEN -100 ELSE v END)[1:1024] AS targets
  FROM padded
)"""

SCORED = """scored AS (
  SELECT vec_id, list_transform(embedding, lambda v: v::double) AS z,
    CASE WHEN label = 0 THEN -100 ELSE label END AS target
  FROM embeddings
),
positions AS (
  SELECT vec_id, target, CASE WHEN target <> -100 THEN
    list_max(z) + ln(list_sum(list_transform(z, lambda v: exp(v - list_max(z))))) - z[target + 1]
  END AS nll
  FROM scored
)"""

FOLLOWERS = """steps AS (
  SELECT unnest(list_zip(ids[1:len(ids) - 1], ids[2:len(ids)])) AS s FROM sequences WHERE len(ids) > 1
),
counted AS (SELECT s[1] AS prev, s[2] AS next, count(*) AS uses FROM steps GROUP BY 1, 2),
followers AS MATERIALIZED (
  SELECT prev, next FROM (
    SELECT *, row_number() OVER (PARTITION BY prev ORDER BY uses DESC, next) AS place FROM counted
  ) WHERE place = 1
)"""

ORACLE: dict[str, str] = {
    "q_rename_pairs": f"""WITH {PAIRS}
SELECT row_id, paraphrased_question AS question, sparql_wikidata AS sparql FROM pairs""",
    "q_union_sparql": f"""WITH {PAIRS}
SELECT sparql_wikidata FROM pairs WHERE part = 'train'
UNION ALL SELECT sparql_wikidata FROM pairs WHERE part = 'test'""",
    "q_extract_ids": f"""WITH {PAIRS},
found AS (SELECT row_id, regexp_extract_all(sparql_wikidata, '{ID}') AS eids FROM pairs)
SELECT row_id, (i - 1)::int AS place, eids[i] AS eid
FROM (SELECT row_id, eids, unnest(range(1, len(eids) + 1)) AS i FROM found)""",
    "q_dictionary": f"WITH {DICTIONARY} SELECT eid, label FROM dictionary",
    "q_dictionary_inverse": f"WITH {DICTIONARY} SELECT label, eid FROM dictionary",
    "q_encode_ids": f"WITH {ENCODED} SELECT row_id, question, sparql, sparql_modf FROM encoded",
    "q_extract_labels": f"""WITH {ENCODED},
found AS (SELECT row_id, regexp_extract_all(sparql_modf, '{LABEL}') AS labels FROM encoded)
SELECT row_id, (i - 1)::int AS place, labels[i] AS label
FROM (SELECT row_id, labels, unnest(range(1, len(labels) + 1)) AS i FROM found)""",
    "q_decode_labels": f"WITH {PAIRS} SELECT row_id, sparql_wikidata AS decoded_sparql FROM pairs",
    "q_split_train": f"{SPLIT} > n",
    "q_split_valid": f"{SPLIT} <= n",
    "q_prompt_train": f"""WITH {ENCODED}
SELECT row_id, {prompt('question', 'sparql_modf')} AS org_text FROM encoded""",
    "q_prompt_test": f"SELECT conv_id, turn, {prompt('text')} AS org_text FROM conversations",
    "q_preview": f"""WITH {PAIRS},
placed AS (
  SELECT *, row_number() OVER (PARTITION BY part ORDER BY row_id) AS place,
    count(*) OVER (PARTITION BY part) AS n_rows FROM pairs
)
SELECT part, row_id, paraphrased_question, sparql_wikidata, n_rows, 4 AS n_columns
FROM placed WHERE place <= 5""",
    "q_csv_roundtrip": "SELECT doc_id, nullif(text, '') AS text, lang, source, n_chars FROM documents",
    "q_tokenize": f"""SELECT doc_id, text AS org_text, {shown(byte_ids('text'))} AS encoded_text,
  octet_length(encode(text))::int AS n_tokens FROM documents""",
    "q_token_texts": f"SELECT doc_id, {shown(byte_texts(byte_ids('text')), '|')} AS decoded_text FROM documents",
    "q_tokenize_special": f"""SELECT conv_id, turn,
  {shown(f"list_concat({byte_ids('role')}, [50256], {byte_ids('text')}, [50256])")} AS encoded_text
FROM conversations""",
    "q_detokenize": "SELECT doc_id, text FROM documents",
    "q_collate": f"""WITH {TURNS}
SELECT batch_id, ord, conv_id, turn, {shown('inputs')} AS inputs, {shown('targets')} AS targets FROM collated""",
    "q_collate_text": f"""WITH {TURNS},
texts AS (
  SELECT batch_id, ord, w, list_concat({byte_texts('ids')},
    list_transform(range(w - len(ids)), lambda x: '<|endoftext|>')) AS t
  FROM wide
)
SELECT batch_id, ord, {shown('t', '|')} AS inputs_txt, {shown('t[2:w]', '|')} AS targets_txt FROM texts""",
    "q_batch_stats": f"""WITH {TURNS}
SELECT batch_id, count(*) AS n_rows, sum(len(ids))::bigint AS n_tokens, max(len(ids) + 1)::int AS padded_length,
  (SELECT ceil(count(*) / 8)::bigint FROM turns) AS n_batches
FROM wide GROUP BY batch_id""",
    "q_batch_export": f"""WITH {TURNS}
SELECT batch_id, string_agg({shown('inputs')}, ';' ORDER BY ord) AS inputs,
  string_agg({shown('targets')}, ';' ORDER BY ord) AS targets
FROM collated GROUP BY batch_id""",
    "q_record_at": f"WITH {TURNS} SELECT ord, conv_id, turn, text AS org_text FROM turns WHERE ord = 7",
    "q_context_window": f"WITH {TURNS} SELECT conv_id, turn, {shown('ids[-64:]')} AS context FROM turns",
    "q_masked_loss": f"""WITH {SCORED},
losses AS (SELECT vec_id // 8 AS batch_id, avg(nll) AS batch_loss FROM positions GROUP BY 1)
SELECT round(avg(batch_loss), 6) AS loss FROM losses""",
    "q_batch_losses": f"""WITH {SCORED}
SELECT vec_id // 4 AS batch_id, round(coalesce(avg(nll), 'nan'::double), 6) AS batch_loss
FROM positions GROUP BY 1""",
    "q_eval_checkpoints": f"""WITH {SCORED},
losses AS (
  SELECT vec_id // 25 AS batch_id, CASE WHEN vec_id % 25 % 5 = 4 THEN 'val' ELSE 'train' END AS split,
    coalesce(avg(nll), 'nan'::double) AS batch_loss
  FROM positions GROUP BY vec_id // 25, 2, vec_id % 25 // 8
),
means AS (
  SELECT batch_id, avg(batch_loss) FILTER (WHERE split = 'train') AS t,
    avg(batch_loss) FILTER (WHERE split = 'val') AS v
  FROM losses WHERE batch_id % 5 = 0 GROUP BY batch_id
)
SELECT 0 AS epoch, batch_id, round(t, 6) AS train_loss, round(v, 6) AS val_loss,
  'epoch 1, batch ' || printf('%06d', batch_id) || ': train ' || printf('%.6f', t)
    || ', validation ' || printf('%.6f', v) AS report
FROM means""",
    "q_argmax": "SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::int AS choice FROM embeddings",
    "q_last_choice": """SELECT vec_id // 8 AS sequence,
  arg_max((list_position(embedding, list_max(embedding)) - 1)::int, vec_id) AS choice
FROM embeddings GROUP BY 1""",
    "q_stored_loss": f"""WITH {SCORED},
losses AS (SELECT vec_id // 16 AS batch_id, coalesce(avg(nll), 'nan'::double) AS batch_loss FROM positions GROUP BY 1)
SELECT round(avg(batch_loss), 6) AS loss FROM losses""",
    "q_softmax": f"""WITH {SCORED},
powers AS (SELECT vec_id, list_transform(z, lambda v: exp(v - list_max(z))) AS e FROM scored),
shares AS (SELECT vec_id, e, list_sum(e) AS total FROM powers)
SELECT vec_id, (i - 1)::int AS pos, round(e[i] / total, 8) AS p
FROM (SELECT vec_id, e, total, unnest(range(1, len(e) + 1)) AS i FROM shares)""",
    "q_next_token": rf"""WITH sequences AS (SELECT regexp_extract_all(text, '\S+') AS ids FROM benchmark),
{FOLLOWERS}
SELECT prev, next FROM followers""",
    "q_greedy_decode": f"""WITH RECURSIVE {ENCODED},
sequences AS (SELECT {byte_ids(f"({prompt('question', 'sparql_modf')})")} AS ids FROM encoded),
{FOLLOWERS},
grown AS (
  SELECT row_id, 0 AS step, {byte_ids(f"({prompt('sparql_modf')})")} AS ids FROM encoded
  UNION ALL
  SELECT row_id, step + 1, list_append(ids[-96:], next)
  FROM grown JOIN followers ON prev = ids[-1] WHERE step < 50 AND next <> 50256
),
ended AS (SELECT row_id, arg_max(ids, step) AS ids FROM grown GROUP BY row_id),
texts AS (
  SELECT row_id, decode(unhex(array_to_string(list_transform(ids, lambda b: printf('%02X', b)), ''))) AS text
  FROM ended
),
names AS (SELECT map(list(label), list(eid)) AS m FROM dictionary)
SELECT e.row_id, t.text AS decoded_text,
  list_reduce(list_concat([t.text], regexp_extract_all(t.text, '{LABEL}')), lambda acc, l:
    CASE WHEN map_contains(m, l) THEN replace(acc, l, m[l]) ELSE acc END) AS decoded_sparql,
  e.sparql AS org_sparql
FROM encoded e JOIN texts t ON t.row_id = e.row_id, names""",
}

ORACLE["q_encode_joined"] = ORACLE["q_encode_ids"]
ORACLE["q_decode_joined"] = ORACLE["q_decode_labels"]


# White space of Unicode, as the pattern's flag has it, and a mark that stands in no text. A run of
# white space gives its last character to what follows; the mark goes before that character, in
# the place of the look-ahead that this engine's patterns do not have.
WHITE = r"\x09-\x0D\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"

MERGED = rf"""marked AS (
  SELECT doc_id, regexp_replace(text, '([{WHITE}]+)([{WHITE}][^{WHITE}])', '\1' || chr(57344) || '\2', 'g') AS t FROM documents
),
cut AS (
  SELECT doc_id, regexp_extract_all(t,
    '''(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}\x{{E000}}]+|[{WHITE}]+') AS words
  FROM marked
),
placed AS (SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS place FROM cut),
words AS MATERIALIZED (SELECT word, hex(encode(word)) AS h, count(*) AS uses FROM placed GROUP BY word),
runs AS (
  SELECT n, substr(h, i, 2 * n) AS run, sum(uses) AS uses
  FROM (SELECT h, uses, n, unnest(range(1, length(h) - 2 * n + 2, 2)) AS i
        FROM words, (VALUES (2), (3)) AS sizes(n))
  GROUP BY n, run
),
ranked AS (SELECT n, run, row_number() OVER (PARTITION BY n ORDER BY uses DESC, run) AS place FROM runs),
merges AS (SELECT run, 255 + place + CASE WHEN n = 3 THEN 150 ELSE 0 END AS id FROM ranked WHERE place <= 150),
ranks AS MATERIALIZED (SELECT map(list(run), list(id)) AS m FROM merges),
steps AS (
  SELECT word, CASE WHEN map_contains(m, h) THEN [h] ELSE regexp_extract_all(h, '..') END AS parts, 0 AS step
  FROM words, ranks
  UNION ALL
  SELECT word, list_concat(parts[1:i - 1], [parts[i] || parts[i + 1]], parts[i + 2:]), step + 1
  FROM (
    SELECT word, parts, step, list_min(list_transform(range(1, len(parts)), lambda j:
      m[parts[j] || parts[j + 1]] * 1048576 + j)) % 1048576 AS i
    FROM steps, ranks
  ) WHERE i IS NOT NULL
),
ends AS (SELECT word, arg_max(parts, step) AS parts FROM steps GROUP BY word),
codes AS (
  SELECT word, array_to_string(list_transform(parts, lambda p:
    CASE WHEN length(p) = 2 THEN ('0x' || p)::INT ELSE m[p] END), ' ') AS ids
  FROM ends, ranks
)"""

ORACLE["q_tokenize_merged"] = f"""WITH RECURSIVE {MERGED},
texts AS (SELECT doc_id, string_agg(ids, ' ' ORDER BY place) AS ids FROM placed JOIN codes USING (word) GROUP BY doc_id)
SELECT n.doc_id, CASE WHEN n.text IS NOT NULL THEN coalesce(ids, '') END AS encoded_text
FROM documents n LEFT JOIN texts x ON x.doc_id = n.doc_id"""
ORACLE["q_detokenize_merged"] = ORACLE["q_detokenize"]

RECORDS = f"""{PAIRS},
records AS (
  SELECT *, row_number() OVER (PARTITION BY split ORDER BY row_id) - 1 AS ord, {byte_ids('org_text')} AS ids
  FROM (
    SELECT row_id, {prompt('paraphrased_question', 'sparql_wikidata')} AS org_text,
      CASE WHEN part = 'test' THEN 'test' WHEN row_id % 10 = 0 THEN 'val' ELSE 'train' END AS split
    FROM pairs
  )
)"""

ORACLE["q_token_table"] = f"""WITH {RECORDS}
SELECT split, ord, row_id, org_text, {shown('ids')} AS encoded_text, {shown(byte_texts('ids'), '|')} AS decoded_text
FROM records WHERE split = 'val'"""
ORACLE["q_loader_batches"] = f"""WITH {RECORDS},
batched AS (SELECT *, ord // CASE WHEN split = 'train' THEN 8 ELSE 4 END AS batch_id FROM records)
SELECT split, batch_id, count(*) AS n_rows, sum(len(ids))::bigint AS n_tokens, max(len(ids) + 1)::int AS padded_length
FROM batched GROUP BY split, batch_id"""
ORACLE["q_csv_numbered"] = f"""WITH {PAIRS}
SELECT row_number() OVER (ORDER BY row_id) - 1 AS row_id, paraphrased_question AS question, sparql_wikidata AS sparql
FROM pairs"""
ORACLE["q_literal_rows"] = f"""WITH asked(row_id, question, org_sparql) AS (
  VALUES (0, '1-URGENT', 'ASK {{ ex:K1 }}'), (1, '5-LOW', 'ASK {{ ex:K2 }}'), (2, 'none', '')
),
counts AS (SELECT o_orderpriority, count(*) AS n_orders FROM orders GROUP BY 1)
SELECT row_id::bigint AS row_id, {prompt('question')} AS org_text, org_sparql, n_orders
FROM asked LEFT JOIN counts ON question = o_orderpriority"""
ORACLE["q_collate_custom"] = f"""WITH {TURNS}
SELECT batch_id, ord,
  {shown("list_concat(list_transform(range(w - 1 - len(ids)), lambda x: -1), ids)")} AS inputs
FROM wide"""
ORACLE["q_model_loss"] = f"""WITH {TURNS.replace('50256', '256')},
steps AS (SELECT batch_id, unnest(inputs) AS x, unnest(targets) AS y FROM collated),
logits AS (SELECT a.v AS x, b.v AS y, ((a.v * 31 + b.v * 7) % 11) / 4 AS z FROM range(257) AS a(v), range(257) AS b(v)),
norms AS (SELECT x, ln(sum(exp(z))) AS norm FROM logits GROUP BY x),
losses AS (
  SELECT batch_id, coalesce(avg(norm - z), 'nan'::double) AS batch_loss
  FROM (SELECT DISTINCT batch_id FROM steps) LEFT JOIN (SELECT * FROM steps WHERE y <> -100) USING (batch_id)
    LEFT JOIN norms USING (x) LEFT JOIN logits USING (x, y)
  GROUP BY batch_id
)
SELECT round(avg(batch_loss), 6) AS loss FROM losses"""
ORACLE["q_greedy_stop"] = f"""WITH RECURSIVE
sequences AS (SELECT list_append({byte_ids('text')}, 50256) AS ids FROM conversations),
{FOLLOWERS},
grown AS (
  SELECT conv_id, turn, 0 AS step, {byte_ids('text')} AS ids FROM conversations
  UNION ALL
  SELECT conv_id, turn, step + 1, list_append(ids[-96:], next)
  FROM grown JOIN followers ON prev = ids[-1] WHERE step < 50 AND next <> 50256
)
SELECT conv_id, turn, {shown('arg_max(ids, step)')} AS generated FROM grown GROUP BY conv_id, turn"""
ORACLE["q_csv_multiline"] = """SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_id, doc_id,
  '"' || text || '",' || chr(13) || chr(10) || '""' || lang || '"' || chr(10) AS text, nullif(source, '') AS source
FROM documents"""
ORACLE["q_dictionary_grown"] = f"""WITH {PAIRS},
of_part AS (
  SELECT DISTINCT part, unnest(regexp_extract_all(sparql_wikidata, '{ID}')) AS eid
  FROM pairs WHERE sparql_wikidata IS NOT NULL
),
versions AS (SELECT eid, min(CASE part WHEN 'train' THEN 0 ELSE 1 END) AS version FROM of_part GROUP BY eid)
SELECT eid, 'ENTITY_' || lpad(cast(row_number() OVER (ORDER BY version, eid) AS varchar), 12, '0') AS label,
  version::bigint AS version
FROM versions
UNION ALL SELECT 'ENTITY_UNK', 'ENTITY_000000000000', 0"""
ORACLE["q_split_parts"] = f"""WITH {PAIRS},
ranked AS (
  SELECT row_id, row_number() OVER (ORDER BY md5('42:' || row_id), row_id) AS place, count(*) OVER () AS n FROM pairs
)
SELECT row_id, CASE WHEN place <= ceil(n * 0.25::double) THEN 0 WHEN place <= ceil(n * 0.375::double) THEN 1 ELSE 2 END AS place
FROM ranked"""
ORACLE["q_observed_counts"] = f"""WITH {PAIRS}
SELECT part, count(*) AS n_rows, ceil(count(*) / CASE part WHEN 'train' THEN 8 ELSE 4 END)::bigint AS n_batches
FROM pairs GROUP BY part"""
# Other ways to the same results.
for name, same in {
    "q_sharded_loss": "q_masked_loss",
    "q_sliced_model_loss": "q_model_loss",
    "q_collate_stored": "q_collate",
    "q_record_stored": "q_record_at",
    "q_batch_sink": "q_batch_export",
    "q_greedy_joined": "q_greedy_stop",
    "q_greedy_states": "q_greedy_stop",
}.items():
    ORACLE[name] = ORACLE[same]
