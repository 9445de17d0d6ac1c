"""Column functions: text, time, money, flags."""
