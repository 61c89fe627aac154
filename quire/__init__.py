"""Document analytics on Spark: runs, search, rules, geometry, links, fonts, layout and keyed state as DataFrame operators."""
