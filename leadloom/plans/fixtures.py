"""Input tables derived from the star schema, as SQL that Spark and DuckDB both run."""

RAW_LEADS = r"""
WITH base AS (
  SELECT c_custkey AS i, c_custkey - c_custkey % 3 AS k, n_name, r_name
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
)
SELECT
  CASE i % 5 WHEN 0 THEN 'directories' WHEN 1 THEN 'web' WHEN 2 THEN 'maps' WHEN 3 THEN 'social' ELSE 'free' END AS profile,
  CAST(i % 5 AS INT) AS profile_rank,
  i AS row_no,
  CASE WHEN i % 37 = 5 THEN '' WHEN i % 41 = 7 THEN 'Barbearias em ' || n_name WHEN i % 43 = 9 THEN 'Yahoo Mail'
       WHEN k % 7 = 0 THEN ' Barbearia  São João ' || CAST(k AS STRING)
       WHEN k % 7 = 1 THEN 'Talho Bragança ' || CAST(k AS STRING)
       WHEN k % 7 = 2 THEN 'Barber Shop ' || CAST(k AS STRING) || ' estética'
       WHEN k % 7 = 3 THEN 'Grooming Açores ' || CAST(k AS STRING)
       ELSE 'Barbershop ' || n_name || ' ' || CAST(k AS STRING) END AS name,
  CASE WHEN i % 6 = 0 THEN 'https://www.Loja' || CAST(k AS STRING) || '.example.pt/contacto?x=1'
       WHEN i % 6 = 1 THEN 'loja' || CAST(k AS STRING) || '.example.pt'
       WHEN i % 6 = 2 THEN 'https://www.fresha.com/a/loja-' || CAST(k AS STRING)
       WHEN i % 6 = 3 THEN 'https://www.google.com/maps/place/' || CAST(k AS STRING)
       WHEN i % 6 = 4 THEN 'loja ' || CAST(k AS STRING) || ' /search/' ELSE '' END AS website,
  CASE WHEN i % 4 = 0 THEN 'https://www.facebook.com/loja' || CAST(k AS STRING) || ' | https://www.instagram.com/loja' || CAST(k AS STRING) || ' | https://www.facebook.com/loja' || CAST(k AS STRING)
       WHEN i % 4 = 1 THEN 'https://instagram.com/heyfresha | https://blog.example.pt/' ELSE '' END AS socials,
  CASE WHEN i % 29 = 3 THEN 'info@booksy.com' WHEN i % 5 IN (0, 2) THEN ' Geral' || CAST(k AS STRING) || '@Loja.example.pt'
       WHEN i % 31 = 4 THEN 'sem email' ELSE '' END AS email,
  CASE WHEN i % 23 = 6 THEN '12 34' WHEN i % 3 = 0 THEN '+351 9' || LPAD(CAST(k AS STRING), 8, '0')
       WHEN i % 3 = 1 THEN '9' || LPAD(CAST(k AS STRING), 8, '0') ELSE '' END AS phone,
  n_name AS locality, r_name AS district,
  'https://src' || CAST(i % 7 AS STRING) || '.example.pt/p/' || CAST(k AS STRING) AS sources,
  CASE WHEN i % 5 = 2 THEN 'Fonte Maps | Meta descrição confirmada.' ELSE 'Fonte web' END AS notes
FROM base
"""

HTML_PAGES = r"""
SELECT s_suppkey AS page_id,
  'https://www.loja' || CAST(s_suppkey AS STRING) || '.example.pt/' AS url,
  '<html><head><title>Barbearia ' || CAST(s_suppkey AS STRING) || '</title>'
  || CASE WHEN s_suppkey % 2 = 0 THEN '<meta name="description" content="Barbearia em ' || n_name || '">' ELSE '' END
  || CASE WHEN s_suppkey % 3 = 0 THEN '<link rel="canonical" href="https://loja' || CAST(s_suppkey AS STRING) || '.example.pt/home">' ELSE '' END
  || CASE WHEN s_suppkey % 4 = 0 THEN '<script type="application/ld+json">{"@type":"LocalBusiness","name":"Barbearia LD ' || CAST(s_suppkey AS STRING) || '","telephone":"21000' || LPAD(CAST(s_suppkey AS STRING), 4, '0') || '","address":{"addressLocality":"' || n_name || '","addressRegion":"R' || CAST(s_nationkey AS STRING) || '"}}</script>' ELSE '' END
  || '</head><body><a href="https://facebook.com/loja' || CAST(s_suppkey AS STRING) || '">fb</a>'
  || CASE WHEN s_suppkey % 5 <> 0 THEN '<a href="mailto:geral' || CAST(s_suppkey AS STRING) || '@loja.example.pt?subject=x">mail</a>' ELSE '' END
  || CASE WHEN s_suppkey % 3 = 1 THEN '<a href="tel:+35191' || LPAD(CAST(s_suppkey AS STRING), 7, '0') || '">tel</a>' ELSE '' END
  || '</body></html>' AS html
FROM supplier JOIN nation ON s_nationkey = n_nationkey
"""
