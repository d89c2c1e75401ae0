"""Common table expressions of the SQL the queries are checked against."""

LATEST = """u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY utt_id ORDER BY loaded_at DESC) AS rn FROM utterances WHERE utt_id IS NOT NULL) WHERE rn = 1)"""
CONV = (
    LATEST
    + r""",
tx AS (SELECT DISTINCT label AS valid, regexp_replace(lower(label), '[^\p{L}\p{N}]+', '', 'g') AS key FROM taxonomy WHERE label IS NOT NULL),
raw AS (SELECT dialogue_id, turn, CASE WHEN lower(trim(actor)) IN ('user', 'client') THEN 'user' WHEN lower(trim(actor)) IN ('agent', 'therapist', 'wizard', 'assistant') THEN 'agent' END AS actor,
  trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS text, regexp_replace(lower(label), '[^\p{L}\p{N}]+', '', 'g') AS key, embedding::DOUBLE[] AS vector FROM u WHERE dialogue_id <> -1 AND turn IS NOT NULL),
conv AS (SELECT dialogue_id, turn, actor, text, coalesce(valid, 'unknown') AS label, vector FROM raw LEFT JOIN tx USING (key) WHERE actor IS NOT NULL)"""
)
SIDES = r"""sides AS (SELECT dialogue_id, m.corpus AS corpus, m.stratum AS stratum, m.side AS side FROM (
  SELECT dialogue_id, min({'corpus': split_part(version, '_', 1), 'stratum': trim(stratum), 'side': regexp_replace(lower(trim(side)), '[\s\-_]+', '_', 'g')}) AS m FROM split_members
  WHERE version IN ('TV_v1', 'STAR_v2') AND dialogue_id IS NOT NULL GROUP BY dialogue_id))"""
TRAIN = """train AS (SELECT c.*, s.corpus || ':' || s.stratum AS flow_id, left(c.actor, 1) || ':' || c.label AS bucket FROM conv c JOIN sides s USING (dialogue_id) WHERE s.side = 'train')"""
TRIE = """pre AS (SELECT flow_id, dialogue_id, list(bucket) OVER (PARTITION BY flow_id, dialogue_id ORDER BY turn) AS s FROM train),
trie AS (SELECT flow_id, array_to_string(s, '|') AS node, CASE WHEN len(s) = 1 THEN '__ROOT__' ELSE array_to_string(s[1:len(s) - 1], '|') END AS parent, s[len(s)] AS bucket, len(s)::BIGINT AS depth, count(*) AS n_dialogues FROM pre GROUP BY ALL)"""
CENTROIDS = """ords AS (SELECT flow_id, actor, label, bucket, row_number() OVER (PARTITION BY flow_id ORDER BY min((dialogue_id, turn))) AS ord FROM train GROUP BY flow_id, actor, label, bucket),
dims AS (SELECT flow_id, actor, label, i, avg(vector[i]) AS m FROM train, range(1, 97) r(i) WHERE vector IS NOT NULL GROUP BY ALL),
means AS (SELECT flow_id, actor, label, list(m ORDER BY i) AS v FROM dims GROUP BY ALL),
cent AS (SELECT o.flow_id, o.bucket, o.actor, o.label, o.ord, list_transform(v, lambda x: CASE WHEN list_dot_product(v, v) > 0 THEN x / sqrt(list_dot_product(v, v)) ELSE x END) AS centroid FROM means JOIN ords o USING (flow_id, actor, label))"""
