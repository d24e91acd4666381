"""loomdoc.streaming"""
