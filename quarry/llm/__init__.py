"""Training-data operators: one module per operator, each with its general
interface, its registered query and (where SQL can say it) its SQL oracle."""
