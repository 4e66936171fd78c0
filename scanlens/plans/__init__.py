"""Jobs made of operators: page plans, loads, snapshots, the registered queries."""
