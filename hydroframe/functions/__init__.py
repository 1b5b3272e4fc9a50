"""Column functions and the value grammars behind them."""
