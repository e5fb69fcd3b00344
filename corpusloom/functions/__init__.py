"""Fixed values and Column expressions."""
