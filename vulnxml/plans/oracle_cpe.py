"""DuckDB twins of the CPE matcher queries (the independent check)."""

from vulnxml.sources.fixtures import with_fx

# CTEs shared by the CPE queries, in dependency order.
CPE_CTES = [
    ("items", "select report_id, list_transform(string_split(replace(replace(substring(cpe_text, 2, "
              "greatest(length(cpe_text) - 2, 0)), '''', ''), '\"', ''), ','), lambda x: trim(x)) as items "
              "from fx_cpe_lists"),
    ("invalid", "select distinct report_id from items where len(items) = 0 or list_contains(items, '')"),
    ("valid_items", "select * from items where report_id not in (select report_id from invalid)"),
    ("cpes", "select report_id, unnest(items) as cpe from valid_items"),
    ("named", "select report_id, case when string_split(cpe, ':')[4] = string_split(cpe, ':')[5] "
              "then string_split(cpe, ':')[4] else concat_ws(' ', string_split(cpe, ':')[4], "
              "string_split(cpe, ':')[5]) end as name from cpes"),
    ("sets", "select report_id, list_sort(list_distinct(list(name))) as names from named "
             "where name is not null group by report_id"),
    ("keyed", "select report_id, names, replace(replace(replace(regexp_replace(lower(array_to_string(names, ', ')), "
              "'[^a-zA-Z_0-9 -/]+', '', 'g'), '''', ''), '\"', ''), ',', '') as key from sets"),
    ("dl", "select distinct doc_id, label from fx_labels where doc_id in (select report_id from keyed)"),
    ("lcount", "select label, count(*) as label_n from dl group by label"),
    ("rarest", "select doc_id, label_n as stratum_n, label as stratum from (select dl.doc_id, dl.label, c.label_n, "
               "row_number() over (partition by dl.doc_id order by c.label_n, dl.label) as rn "
               "from dl join lcount c using (label)) x where rn = 1"),
    ("ranked", "select k.report_id, row_number() over (order by coalesce(r.stratum_n, 4611686018427387904), "
               "coalesce(r.stratum, ''), md5('42|' || cast(k.report_id as varchar)), k.report_id) as r "
               "from keyed k left join rarest r on r.doc_id = k.report_id"),
    ("split", "select report_id, case when floor(r * 1 / 5) > floor((r - 1) * 1 / 5) then 'test' else 'train' end "
              "as split from ranked"),
    ("train", "select k.* from keyed k join split s using (report_id) where s.split = 'train'"),
    ("test", "select k.* from keyed k join split s using (report_id) where s.split = 'test'"),
    ("clabels", "select doc_id as report_id, trim(regexp_replace(label, '[^a-zA-Z_0-9 -/]+', '', 'g')) as label "
                "from fx_labels"),
    ("matcher", "select key, label, count(*) as cnt from train join clabels using (report_id) group by key, label"),
    ("selected", "select key, label, cnt from (select *, sum(cnt) over (partition by key) as tot, "
                 "count(*) over (partition by key) as k from matcher) x where cnt * k >= tot"),
    ("pred_exact", "select t.report_id, s.label, t.key as matched_key from test t join selected s using (key)"),
    ("truth", "select distinct c.report_id, c.label from clabels c join test t using (report_id)"),
    # Nearest training key for test keys without an exact hit: cosine over
    # md5-bucket token counts (64 buckets), rounded to 9 places, ties -> key.
    ("tkeys", "select distinct key from train"),
    ("mkeys", "select distinct key from test where key not in (select key from selected)"),
    ("kv", "select key, bucket, count(*) as c from (select key, cast(('0x' || substr(md5(t), 1, 8)) as bigint) % 64 "
           "as bucket from (select key, unnest(list_filter(string_split_regex(key, '\\s+'), lambda w: w <> '')) as t "
           "from (select key from tkeys union select key from mkeys) a) b) c group by key, bucket"),
    ("norms", "select key, sqrt(sum(c * c)) as nrm from kv group by key"),
    ("dots", "select q.key as query, k.key as tkey, sum(q.c * k.c) as dot from kv q join kv k on q.bucket = k.bucket "
             "where q.key in (select key from mkeys) and k.key in (select key from tkeys) group by 1, 2"),
    ("sims", "select m.key as query, t.key as tkey, round(coalesce(d.dot / nullif(nq.nrm * nt.nrm, 0), 0), 9) as sim "
             "from mkeys m cross join tkeys t left join dots d on d.query = m.key and d.tkey = t.key "
             "left join norms nq on nq.key = m.key left join norms nt on nt.key = t.key"),
    ("nearest", "select query, tkey from (select *, row_number() over (partition by query order by sim desc, tkey) "
                "as rn from sims) x where rn = 1"),
    ("pred_nearest", "select t.report_id, s.label, n.tkey as matched_key from test t join nearest n on n.query = t.key "
                     "join selected s on s.key = n.tkey"),
]


def cpe_sql(body: str) -> str:
    return with_fx(["fx_cpe", "fx_cpe_lists", "fx_labels"], body, CPE_CTES)


ORACLE_CPE = {
    "J1_drop_invalid_reports": cpe_sql("select report_id from invalid"),
    "P7_parse_list_repr": cpe_sql("select report_id, cast(len(items) as bigint) as n_items, "
                                  "array_to_string(items, '|') as items from items"),
    "A1_library_sets": cpe_sql("select report_id, array_to_string(names, '|') as names, key from keyed"),
    "D1_stratified_split": cpe_sql("select report_id, split from split"),
    "A2_build_matcher": cpe_sql("select key, label, cast(cnt as bigint) as cnt from matcher"),
    "A3_select_labels": cpe_sql("select key, label, cast(cnt as bigint) as cnt from selected"),
    "A3_select_labels_top_n": cpe_sql("select key, label, cast(cnt as bigint) as cnt from (select *, row_number() "
                                      "over (partition by key order by cnt desc, label) as r from matcher) x "
                                      "where r <= 2"),
    "A3_select_labels_all": cpe_sql("select key, label, cast(cnt as bigint) as cnt from matcher"),
    "J3_match_exact": cpe_sql("select report_id, label, matched_key from pred_exact"),
    "J3_match_or_nearest": cpe_sql("select report_id, label, matched_key from pred_exact union all "
                                   "select report_id, label, matched_key from pred_nearest"),
    "M6_set_precision_recall": cpe_sql(
        "select cast(count(*) filter (where p.report_id is not null and t.report_id is not null) as bigint) "
        "as n_correct, cast(count(p.report_id) as bigint) as n_pred, cast(count(t.report_id) as bigint) as n_true, "
        "round(count(*) filter (where p.report_id is not null and t.report_id is not null) * 1.0 "
        "/ nullif(count(p.report_id), 0), 6) as precision, "
        "round(count(*) filter (where p.report_id is not null and t.report_id is not null) * 1.0 "
        "/ nullif(count(t.report_id), 0), 6) as recall "
        "from (select distinct report_id, label from pred_exact) p "
        "full outer join truth t on p.report_id = t.report_id and p.label = t.label"),
}
