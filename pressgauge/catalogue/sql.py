"""The same tables in DuckDB SQL, as named common table expressions."""

from __future__ import annotations

THEME_KEY = "upper(trim(split_part(trim(x), ',', 1)))"
HOST = r"rtrim(regexp_extract({0}, 'https?://(?:www\.)?([^/?:]+)', 1), '.')"
VALID = r"regexp_matches(DATE, '^\d{14}$') AND GKGRECORDID <> '20210925181500-T1111'"
THEMED = "EnhancedThemes IS NOT NULL AND EnhancedThemes <> ''"
DAY = "CAST(strptime(substr(DATE, 1, 8), '%Y%m%d') AS DATE)"

# Shift before rounding, so that exact decimal ties fall the same way in both engines.
def r6(expr: str) -> str:
    return f"round(({expr}) + 1e-9, 6)"


_CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "order_lines": ((), """
        SELECT l_orderkey,
               string_agg(upper(replace(p_name, ' ', '_')) || ',' || l_partkey || ';' || p_type || ',' || l_suppkey, ';'
                          ORDER BY l_linenumber, l_partkey, l_suppkey) AS themes,
               string_agg('1#' || n_name || '#N' || s_nationkey, ';'
                          ORDER BY l_linenumber, l_partkey, l_suppkey) AS places,
               CAST(sum(l_quantity) AS INTEGER) AS words
        FROM lineitem JOIN part ON l_partkey = p_partkey
             JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
        GROUP BY l_orderkey"""),
    "gkg": (("order_lines",), """
        SELECT strftime(o_orderdate, '%Y%m%d%H%M%S') || '-' || o_orderkey AS GKGRECORDID,
               CASE WHEN o_orderkey % 97 = 0 THEN 'bad' ELSE strftime(o_orderdate, '%Y%m%d%H%M%S') END AS DATE,
               CAST(CASE WHEN o_orderkey % 7 = 0 THEN 2 ELSE 1 END AS TINYINT) AS SourceCollectionIdentifier,
               CAST(CASE WHEN o_orderkey % 20 = 0 THEN 0 ELSE o_custkey % 50 + 1 END AS INTEGER) AS SourceCommonName_ID,
               'https://www.src' || (o_custkey % 53) || '.example.com/a/' || o_orderkey AS DocumentIdentifier,
               themes AS EnhancedThemes, places AS EnhancedLocations,
               CASE WHEN o_orderkey % 11 = 0 THEN ''
                    ELSE 'Person ' || (o_custkey % 100) || '; Person ' || (o_custkey % 7) END AS Persons,
               CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE o_orderpriority || ';' || o_orderstatus END AS Organizations,
               CASE WHEN o_orderkey % 3 = 0 THEN 'srclc:fra' ELSE '' END AS TranslationInfo,
               CAST(CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS TINYINT) AS IsTranslingual,
               CAST((CAST(round(o_totalprice * 100) AS BIGINT) % 2001 - 1000) / 100.0 AS DOUBLE) AS Tone,
               words AS WordCount
        FROM orders LEFT JOIN order_lines ON o_orderkey = l_orderkey"""),
    "src_map": ((), """
        SELECT DISTINCT CAST(c_custkey % 50 + 1 AS INTEGER) AS SourceCommonName_ID,
               'src' || (c_custkey % 50) || '.example.com' AS SourceCommonName
        FROM customer"""),
    # Outlets of very different volume: the first has a third of all articles.
    "skewed": ((), """
        SELECT strftime(moved, '%Y%m%d%H%M%S') || '-' || o_orderkey AS GKGRECORDID,
               CASE WHEN o_orderkey % 97 = 0 THEN 'bad' ELSE strftime(moved, '%Y%m%d%H%M%S') END AS DATE,
               outlet AS Src_ID
        FROM (SELECT o_orderkey, o_orderdate + to_months(CAST(o_orderkey % 2 * 72 AS INTEGER)) AS moved,
                     CAST(CASE WHEN o_orderkey % 3 = 0 THEN 1
                          ELSE 2 + floor(o_custkey / pow(2, (o_orderkey // 3) % 12)) END AS INTEGER) AS outlet
              FROM orders)"""),
    "skewed_dated": (("skewed",), f"SELECT * FROM skewed WHERE {VALID}"),
    "taxonomy": ((), """
        SELECT DISTINCT * FROM (
          SELECT 'goods' AS sector, split_part(p_name, ' ', 2) AS cat_key, upper(replace(p_name, ' ', '_')) AS theme
          FROM part WHERE split_part(p_name, ' ', 2) IN ('bolt', 'gear', 'ring', 'rod')
          UNION ALL
          SELECT 'colour', split_part(p_name, ' ', 1), upper(replace(p_name, ' ', '_'))
          FROM part WHERE split_part(p_name, ' ', 1) IN ('red', 'blue')
          UNION ALL SELECT 'colour', 'econ', p_type FROM part WHERE p_type = 'ECONOMY'
          UNION ALL
          SELECT 'scale', CASE WHEN p_type = 'ECONOMY' THEN 'econ' ELSE 'size' END, p_type
          FROM part WHERE p_type IN ('ECONOMY', 'LARGE', 'SMALL'))"""),
    "regions": ((), """
        SELECT r_name AS region_key, 'N' || n_nationkey AS country_code
        FROM nation JOIN region ON n_regionkey = r_regionkey
        UNION ALL
        SELECT 'THIRD', 'N' || n_nationkey FROM nation WHERE n_nationkey % 3 = 0"""),
    "dated": (("gkg",), f"SELECT * FROM gkg WHERE {VALID}"),
    "repaired": (("dated", "src_map"), f"""
        SELECT g.*, coalesce(nullif(g.SourceCommonName_ID, 0), m.SourceCommonName_ID) AS Src_ID
        FROM dated g LEFT JOIN src_map m ON {HOST.format('g.DocumentIdentifier')} = m.SourceCommonName"""),
    # Dated rows with a known source, whatever their themes and length.
    "sourced": (("repaired",), "SELECT * FROM repaired WHERE Src_ID IS NOT NULL"),
    # Dated, themed rows with a known source.
    "inter": (("repaired",), f"SELECT * FROM repaired WHERE Src_ID IS NOT NULL AND {THEMED}"),
    "base": (("inter",), "SELECT * FROM inter WHERE WordCount BETWEEN 15 AND 6500"),
    "valid_sources": (("base",), """
        SELECT Src_ID FROM base GROUP BY Src_ID
        HAVING count(*) >= 30 AND count(DISTINCT substr(DATE, 1, 4)) >= 2"""),
    # Text columns of the articles that remain after all filters.
    "final": (("base", "valid_sources"), """
        SELECT b.* FROM base b JOIN valid_sources USING (Src_ID)
        WHERE len(string_split(EnhancedThemes, ';')) >= 2"""),
    "clean": (("final",), f"""
        SELECT GKGRECORDID, {DAY} AS period, Tone AS tone, sign(Tone) AS tone_bin,
               len(string_split(EnhancedThemes, ';')) AS total_themes_count,
               list_transform(string_split(EnhancedThemes, ';'), lambda x: {THEME_KEY}) AS themes_list,
               list_filter(list_distinct(list_transform(string_split(EnhancedLocations, ';'),
                           lambda x: split_part(x, '#', 3))), lambda c: c <> '') AS countries_list
        FROM final"""),
    "total_news": (("clean",), """
        SELECT period, count(DISTINCT GKGRECORDID) AS total_news FROM clean GROUP BY 1"""),
    "hits": (("clean", "taxonomy"), """
        SELECT GKGRECORDID, period, tone, tone_bin, total_themes_count, sector, cat_key, count(*) AS theme_hits
        FROM (SELECT GKGRECORDID, period, tone, tone_bin, total_themes_count, unnest(themes_list) AS theme FROM clean)
             JOIN taxonomy USING (theme)
        GROUP BY ALL"""),
    "cat_sums": (("hits",), """
        SELECT period, sector, cat_key AS granularity, count(*) AS N, sum(w) AS sum_w, sum(tone) AS sum_t_cont,
               CAST(sum(tone_bin) AS BIGINT) AS sum_t_bin, sum(tone * w) AS sum_t_cont_w,
               sum(tone_bin * w) AS sum_t_bin_w
        FROM (SELECT *, theme_hits::DOUBLE / total_themes_count AS w FROM hits)
        GROUP BY period, sector, cat_key"""),
    "art_sector": (("hits",), """
        SELECT GKGRECORDID, period, sector, any_value(tone) AS tone, any_value(tone_bin) AS tone_bin,
               sum(theme_hits)::DOUBLE / any_value(total_themes_count) AS w
        FROM hits GROUP BY GKGRECORDID, period, sector"""),
    "sec_sums": (("art_sector",), """
        SELECT period, sector, '__sector__' AS granularity, count(*) AS N, sum(w) AS sum_w, sum(tone) AS sum_t_cont,
               CAST(sum(tone_bin) AS BIGINT) AS sum_t_bin, sum(tone * w) AS sum_t_cont_w,
               sum(tone_bin * w) AS sum_t_bin_w
        FROM art_sector GROUP BY period, sector"""),
    "indicators": (("cat_sums", "sec_sums", "total_news"), """
        SELECT *, att * sent_cont AS axs_cont, att_weight * sent_cont_weight AS axs_cont_weight,
               att * sent_bin AS axs_bin, att_weight * sent_bin_weight AS axs_bin_weight
        FROM (SELECT *, N::DOUBLE / total_news AS att, sum_w / total_news AS att_weight, sum_t_cont / N AS sent_cont,
                     sum_t_bin::DOUBLE / N AS sent_bin, sum_t_cont_w / sum_w AS sent_cont_weight,
                     sum_t_bin_w / sum_w AS sent_bin_weight
              FROM (SELECT * FROM cat_sums UNION ALL SELECT * FROM sec_sums) JOIN total_news USING (period))"""),
    "art_regions": (("clean", "regions"), """
        SELECT DISTINCT GKGRECORDID, period, region_key
        FROM (SELECT GKGRECORDID, period, unnest(countries_list) AS country_code FROM clean)
             JOIN regions USING (country_code)"""),
    "total_region": (("art_regions",), """
        SELECT period, region_key, count(DISTINCT GKGRECORDID) AS total_news FROM art_regions GROUP BY 1, 2"""),
    "geo_hits": (("clean", "art_regions", "taxonomy"), """
        SELECT GKGRECORDID, period, region_key, tone, tone_bin, total_themes_count, sector, cat_key,
               count(*) AS theme_hits
        FROM (SELECT g.GKGRECORDID, g.period, region_key, tone, tone_bin, total_themes_count,
                     unnest(themes_list) AS theme
              FROM clean g JOIN art_regions a ON g.GKGRECORDID = a.GKGRECORDID) JOIN taxonomy USING (theme)
        GROUP BY ALL"""),
    "geo_indicators": (("geo_hits", "total_region"), """
        SELECT *, att * sent_cont AS axs_cont, att_weight * sent_cont_weight AS axs_cont_weight,
               att * sent_bin AS axs_bin, att_weight * sent_bin_weight AS axs_bin_weight
        FROM (SELECT *, N::DOUBLE / total_news AS att, sum_w / total_news AS att_weight, sum_t_cont / N AS sent_cont,
                     sum_t_bin::DOUBLE / N AS sent_bin, sum_t_cont_w / sum_w AS sent_cont_weight,
                     sum_t_bin_w / sum_w AS sent_bin_weight
              FROM (SELECT period, region_key, sector, granularity, count(*) AS N, sum(w) AS sum_w,
                           sum(tone) AS sum_t_cont, CAST(sum(tone_bin) AS BIGINT) AS sum_t_bin,
                           sum(tone * w) AS sum_t_cont_w, sum(tone_bin * w) AS sum_t_bin_w
                    FROM (SELECT period, region_key, sector, cat_key AS granularity, tone, tone_bin,
                                 theme_hits::DOUBLE / total_themes_count AS w FROM geo_hits
                          UNION ALL
                          SELECT period, region_key, sector, '__sector__', any_value(tone), any_value(tone_bin),
                                 sum(theme_hits)::DOUBLE / any_value(total_themes_count)
                          FROM geo_hits GROUP BY GKGRECORDID, period, region_key, sector)
                    GROUP BY period, region_key, sector, granularity)
                   JOIN total_region USING (period, region_key))"""),
    "domains": ((), """
        SELECT CAST(c_custkey % 30 + 1 AS VARCHAR) AS id, 'src' || (c_custkey % 30) || '.example.com' AS domain,
               c_name AS medialabel, c_mktsegment AS typelabel, 'NATION_' || c_nationkey AS countrylabel,
               CASE WHEN c_custkey % 4 = 0 THEN '' ELSE CAST(c_custkey + 1900 AS VARCHAR) END AS inception
        FROM customer"""),
    "registry": ((), """
        SELECT *, CASE c_custkey % 4 WHEN 0 THEN 'https://www.' || host || '/' WHEN 1 THEN ' ' || host || '/p'
                  WHEN 2 THEN 'www.' || host || ':8080/p' ELSE 'http://WWW.' || host END AS website
        FROM (SELECT c_custkey, CASE c_nationkey % 3 WHEN 0 THEN 'EU' WHEN 1 THEN 'US' ELSE 'AS' END AS region,
                     c_name || CASE c_custkey % 10 WHEN 3 THEN ' University' WHEN 7 THEN ' Daily SPORTS' ELSE '' END
                       AS medialabel,
                     c_mktsegment AS typelabel, 'NATION_' || c_nationkey AS countrylabel,
                     CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE CAST(c_custkey + 1900 AS VARCHAR) END AS inception,
                     CASE WHEN c_custkey % 5 = 0 THEN 'news.' ELSE '' END || 'src' || (c_custkey % 70)
                       || '.example.com' AS host
              FROM customer)"""),
    "daily": ((), """
        SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n_articles,
               avg((CAST(round(o_totalprice * 100) AS BIGINT) % 2001 - 1000) / 100.0) AS tone
        FROM orders GROUP BY 1"""),
    "macro": ((), """
        SELECT r_name AS region_key, CAST(date_trunc('month', l_shipdate) AS DATE) AS period,
               sum(l_extendedprice) AS value
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
             JOIN region ON n_regionkey = r_regionkey
        GROUP BY 1, 2"""),
    "market": ((), """
        SELECT CAST(o_orderdate AS DATE) AS day, avg(o_totalprice) AS price
        FROM orders WHERE isodow(o_orderdate) < 6 GROUP BY 1"""),
}


def add(name: str, needs: tuple[str, ...], text: str) -> None:
    _CTES[name] = (needs, text)


def query(body: str, *needs: str, **extra: str) -> str:
    """A full statement: the needed expressions in order, then ``body``.

    ``extra`` adds expressions of this statement alone, in the given order.
    """
    order: list[str] = []

    def visit(name: str) -> None:
        for dependency in _CTES[name][0]:
            visit(dependency)
        if name not in order:
            order.append(name)

    for name in needs:
        visit(name)
    parts = [f"{n} AS ({_CTES[n][1]})" for n in order] + [f"{n} AS ({t})" for n, t in extra.items()]
    return ("WITH RECURSIVE " + ",\n".join(parts) + "\n" if parts else "") + body
