"""quadrille.plans"""
