"""Parts of DuckDB SQL that equal native columns; each takes a column's name by format()."""

FOLD = "replace(lower({}), 'ß', 'ss')"
SQUEEZE = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
TOKENS = "regexp_extract_all(" + FOLD + ", '[a-z0-9]+')"
ENGLISH = r"length(regexp_replace({0}, '[^A-Za-z]', '', 'g'))::DOUBLE / nullif(length(regexp_replace({0}, '[^\p{{L}}]', '', 'g')), 0)"
