"""Column functions: text helpers, span arrays, validators and scores. All return Columns; none starts a job."""
