"""Reading tables, dated snapshots, recipes, DDL, mapping XML and control rows; writing targets."""
