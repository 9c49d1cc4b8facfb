"""Training-data pipeline operators (numbered op1..op10) and their registered queries."""
