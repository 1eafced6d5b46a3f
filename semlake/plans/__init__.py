"""From syntax trees to DataFrames: algebra, catalog, stars, terms, compilation."""
