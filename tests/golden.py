"""Published fold scores and ranks, as plain values."""

# Macro F1 of three models over the same 25 folds.
FOLD_SCORES = {
    "RandomForest": (
        0.4817927170868347, 0.5532830765869113, 0.6136004857316333, 0.5059288537549408, 0.7055555555555556,
        0.6616632160110422, 0.604549277318156, 0.6560289612921192, 0.6080064568200162, 0.4253443526170799,
        0.6515351139857068, 0.6953405017921147, 0.4505982905982906, 0.6326777087646652, 0.5090399796282149,
        0.6511784511784512, 0.6106403013182674, 0.5362718089990817, 0.5304891015417331, 0.4808841099163679,
        0.6871345029239766, 0.6974288337924701, 0.5768398268398268, 0.4738292011019283, 0.5313190862196021,
    ),
    "XGBoost": (
        0.4724164724164724, 0.657044755858985, 0.617837000672102, 0.5307621671258035, 0.6296296296296297,
        0.6671717171717173, 0.5986609686609686, 0.6302611367127496, 0.5126676602086438, 0.3476584022038567,
        0.686030263105362, 0.6256374269005848, 0.4848484848484848, 0.6620071684587813, 0.5765950824774354,
        0.6214962198749966, 0.5787382016890213, 0.5832739368020907, 0.5433119069482707, 0.5086292968192839,
        0.7551789077212806, 0.569151138716356, 0.5473862433862434, 0.5126676602086438, 0.5426185212478506,
    ),
    "DecisionTree": (
        0.497638055160179, 0.5136131961820035, 0.5997150997150996, 0.4835854341736694, 0.6124677791344458,
        0.5273585273585274, 0.48408057179987, 0.5772128060263654, 0.6220580186097427, 0.4531034482758621,
        0.5966625966625966, 0.513095238095238, 0.4418463037388869, 0.5536358102729784, 0.4279100529100528,
        0.5379310344827587, 0.681994301994302, 0.4995251661918328, 0.5245358090185676, 0.4266574266574266,
        0.6696998722860791, 0.5698505523066927, 0.45311532268054, 0.4628019323671498, 0.5686609686609687,
    ),
}

# Published p of each model against the best one.
P_VALUES = {"DecisionTree": 0.0010271072387695, "XGBoost": 1.0}

# Ranks of 34 features under two labels; correlation 0.495, p 0.0029.
RANKS_A = (
    1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17,
    18, 19, 20, 21, 22, 23, 24, 25, 26, 27, 29, 30, 31, 32, 33, 34, 35,
)
RANKS_B = (
    1, 5, 12, 4, 10, 24, 3, 32, 7, 6, 25, 11, 21, 20, 19, 9, 17,
    27, 8, 28, 30, 13, 22, 29, 18, 15, 31, 33, 26, 23, 34, 16, 35, 2,
)
