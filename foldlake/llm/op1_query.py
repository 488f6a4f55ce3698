"""op1_url_filter: every page judged by the fixed rules, then by reputation."""

from .common import read
from .url_filter import SUFFIXES, judge_urls

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op1_url_filter(spark, sf_dir):
    return judge_urls(read(spark, sf_dir, "pages"), RULES).drop("lower")


QUERIES = {"op1_url_filter": op1_url_filter}

_FITS = "(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')"
_CASES = [(h, p, v) for h, p, v in sorted(RULES, key=lambda r: (-len(r[0] + r[1]), r))]
_RULE = "case " + " ".join(f"when {_FITS.format(h=h, p=p)} then '{h}{p}'" for h, p, v in _CASES) + " end"
_VERDICT = "case " + " ".join(f"when {_FITS.format(h=h, p=p)} then '{v}'" for h, p, v in _CASES) + " end"

# The counts of a level, and the strength of the prior that its groups get from the level above.
_SUMS = "select '{0}' as level, count(*)::double as g, coalesce(sum(n), 0)::double as n, coalesce(sum(k), 0)::double as k, coalesce(sum(k::double * k / n), 0) as q from {0} where n > 0"
_TWO = ", ".join(f"'{s}'" for s in SUFFIXES)
_POSTERIOR = """select {keys}, mean, mean * (1 - mean) / (n + worth + 1) as var from (
  select {keys}, n, worth, (k + worth * up) / (n + worth) as mean from (
    select {keys}, n, k, up, case when spread > 0 then up * (1 - up) / spread - 1 else 1000.0 end as worth from (
      select {keys}, n, k, up, upvar + (up * (1 - up) - upvar) / (1 + (select pseudo from strength where level = '{level}')) as spread
      from ({rows}))))"""


def _posterior(level, keys, rows):
    return _POSTERIOR.format(level=level, keys=keys, rows=rows)


ORACLE = {"op1_url_filter": f"""
with u as (
  select page_id, case when url is null or instr(url, '://') = 0 then '' else substr(url, instr(url, '://') + 3) end as rest from pages
), hp as (
  select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u
), r as (
  select *, {_RULE} as rule, {_VERDICT} as rv, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') as site from hp
), labels as (
  select site, regexp_matches(site, '^([0-9]+([.][0-9]+){{3}}|[[].*)$') as address, string_split(site, '.') as parts, rv from r
), named as (
  select site, case when address then site when array_to_string(parts[-2:], '.') in ({_TWO}) then array_to_string(parts[-3:], '.') else array_to_string(parts[-2:], '.') end as domain,
    case when address then site when array_to_string(parts[-2:], '.') in ({_TWO}) then array_to_string(parts[-2:], '.') else parts[-1] end as suffix, rv from labels
), sites as (select site, domain, suffix, count(rv) as n, count(*) filter (rv = 'block') as k from named group by all),
domains as (select domain, suffix, sum(n) as n, sum(k) as k from sites group by all),
suffixes as (select suffix, sum(n) as n, sum(k) as k from sites group by all),
sums as ({_SUMS.format('sites')} union all {_SUMS.format('domains')} union all {_SUMS.format('suffixes')}),
overall as (select 'all' as level, case when n > 0 then 1.0 else 0.0 end as g, n, k, case when n > 0 then k * k / n else 0.0 end as q from sums where level = 'sites'),
ups as (
  select c.*, p.g as pg, p.q as pq from (select * from sums) c join (select * from sums union all select * from overall) p
  on (c.level, p.level) in (('sites', 'domains'), ('domains', 'suffixes'), ('suffixes', 'all'))
), squares as (select *, (q - pq) / nullif(g - pg, 0) as msb, (k - q) / nullif(n - g, 0) as msw, least(greatest(g, 0.5), 1000.0) as most from ups),
icc as (select *, case when g > pg and n > g and msb + (n / g - 1) * msw > 0 then round((msb - msw) / (msb + (n / g - 1) * msw), 9) else 0.0 end as r from squares),
strength as (select level, case when r > 0 then least(greatest((1 - r) / r, 0.5), most) else most end as pseudo from icc),
root as (
  select rate as up, rate * (1 - rate) / (groups + 3) as upvar from (
    select groups, (groups * (case when n > 0 then round(k / n, 9) else 0.0 end) + 1) / (groups + 2) as rate
    from overall, (select g as groups from sums where level = 'suffixes'))
),
ps as ({_posterior('suffixes', 'suffix', 'select * from suffixes, root')}),
pd as ({_posterior('domains', 'domain', 'select d.*, mean as up, var as upvar from domains d join ps using (suffix)')}),
ph as ({_posterior('sites', 'site', 'select s.*, mean as up, var as upvar from sites s join pd using (domain)')}),
rep as (select site, round(mean - 1.645 * sqrt(var), 9) >= 0.5 as blocked from ph)
select page_id, host, path, rule, coalesce(rv, case when blocked then 'block' else 'allow' end) as verdict
from r join rep using (site)
"""}
