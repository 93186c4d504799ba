"""Table operators: names, reshaping, filters, joins and grids."""
