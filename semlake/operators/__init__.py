"""Solution operators: joins, optionals, unions, modifiers, query forms."""
